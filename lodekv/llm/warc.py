"""WARC archives: a deduplicating writer and a salvage reader.

Writer: one gzip member per record. Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the largest id is a ``response``, the others are ``revisit`` records that refer to it. Which one that is comes
from a pre-aggregated group-by of payload digests. Only payloads whose digest may repeat are shuffled for it: a Bloom
filter of the repeated digests, of at most ``FILTER_BITS`` bits whatever their number, lets the others pass by
(a false hit is shuffled without effect); hot payloads are joined by a broadcast of proven size (see
``runtime.join_unique``). Archives are written by Spark's own writer, with its commit protocol: a row is a run of members
of about ``RUN_BYTES``, a file at most ``RUNS_PER_FILE`` of them, so it is bounded by bytes. A run's last byte is the
line separator of the text format (a member that ends otherwise is followed by an empty one, as gzip allows), so
the files are plain multi-member ``.warc.gz`` bytes.

Salvage reader: each member is inflated with its checksum, and its record's version line, length and digests are
checked. After a failed check the reader looks for the next valid member or version line, goes on there, and
logs the bytes in between as a quarantined gap (offset, length, reason). The search also goes on inside a member of
several records: a damaged one is skipped up to the next version line, and of a member whose checksum, stream or end is
damaged the records that were inflated are kept if their own digest confirms them. A gap inside a member has the
member's offset, and its length in inflated bytes. So a record whose bytes are intact and confirmed is not lost to damage
elsewhere in its file, but for those behind a break in their own compressed member.

Defined results: null html is an empty payload; a null url is written as ``NO_URL`` and read back as null; a null id has
the record id ``null``, takes part as a copy and is never referred to; where all copies have null ids, all are
responses; rows that repeat the largest id are all responses; line breaks in URLs are percent-encoded; payloads of any
length are written and read whole (an archive of another writer is one row to Spark, so 2 GB at most); an empty table
gives an archive without records; only the three columns named are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import join_unique, materialize, shared_path, workers_can_import

MIN_REVISIT = 1000
#: Bytes of members in one row, rows in one archive file at most, and the gzip level.
RUN_BYTES, RUNS_PER_FILE, LEVEL = 1 << 20, 16, 4
#: Bits of the largest filter of repeated digests (4 MiB), and its hash functions.
FILTER_BITS, FILTER_HASHES = 1 << 25, 4
DATE = "1970-01-01T00:00:00Z"
NO_URL = "urn:lodekv:no-url"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)

GZIP = b"\x1f\x8b\x08"
_version = re.compile(rb"WARC/1\.[01]\r\n")
_candidate = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_header = re.compile(rb"([^\s:]+):[ \t]*([^\r\n]*)\r\n")


def member(data: bytes) -> bytes:
    """One gzip member; it ends with a zero byte, if need be that of an empty member after it."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """The bytes of one WARC 1.1 record."""
    digest = "sha1:" + hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (NO_URL if url is None else url).replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_ID.format('null' if page_id is None else page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_ID.format(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    #: Whether a digest of its own confirmed the block.
    confirmed: bool = False

    def number(self, name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", self.headers.get(name, ""))
        return int(m[1]) if m else None

    def payload(self) -> tuple[int, bytes]:
        """(length of the full payload as its HTTP header says, payload bytes that are here)."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
        return (int(m[1]) if m else len(body)), body


@dataclass(frozen=True)
class Gap:
    """Lost bytes of the file; where ``inside`` is set, inflated bytes from there on of the member at ``offset``."""

    offset: int
    length: int
    reason: str
    inside: int | None = None


class Damaged(ValueError):
    """A check failed."""


def parse_record(data: bytes, at: int, offset: int) -> tuple[Record, int]:
    """The record at ``at`` and where it ends; raises ``Damaged``."""
    if not _version.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    headers = {m[1].decode("latin-1"): m[2].decode("utf-8", "replace") for m in _header.finditer(data, data.index(b"\r\n", at) + 2, end + 2)}
    low = {k.lower(): v for k, v in headers.items()}
    if not low.get("content-length", "").isdigit() or "warc-type" not in low:
        raise Damaged("headers are incomplete")
    first, length = end + 4, int(low["content-length"])
    last = first + length
    if data[last : last + 4] != b"\r\n\r\n":
        raise Damaged("length is wrong or the record is cut off")
    block = data[first:last]
    digest = low.get("warc-block-digest", "")
    known = digest.startswith("sha1:")
    if known and digest[5:] != hashlib.sha1(block).hexdigest():
        raise Damaged("block digest differs")
    return Record(offset, headers, block, known), last + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(inflated bytes, end of the member, what is wrong with it) of the gzip member at ``at``."""
    opener, plain, end, step = zlib.decompressobj(31), [], at, 4096
    wrong = None
    while not opener.eof and end < len(data):
        piece = data[end : end + step]
        try:
            plain.append(opener.decompress(piece))
        except zlib.error as error:
            wrong = f"member: {error}"
            plain = [_up_to_damage(data, at, end, step)]
            break
        end, step = min(len(data), end + step), min(1 << 20, 4 * step)
    if wrong is None and not opener.eof:
        wrong = "member is cut off"
    return b"".join(plain), end - len(opener.unused_data), wrong


def _up_to_damage(data: bytes, at: int, sound: int, step: int) -> bytes:
    """What inflates of the member at ``at``, whose bytes up to ``sound`` do, before the damage in the next ``step`` bytes."""
    opener = zlib.decompressobj(31)
    out = [opener.decompress(data[at:sound])]
    try:
        for k in range(sound, min(len(data), sound + step), 16):
            out.append(opener.decompress(data[k : min(k + 16, sound + step)]))
    except zlib.error:
        pass
    return b"".join(out)


def _records_within(plain: bytes, at: int, sound: bool) -> Iterator[Record | Gap]:
    """Records and gaps of the inflated bytes of the member at ``at``; of an unsound one only confirmed records."""
    pos, lost, reason = 0, None, ""
    while pos < len(plain):
        try:
            found, end = parse_record(plain, pos, at)
            if not sound and not found.confirmed:
                raise Damaged("no digest confirms a record of a damaged member")
        except Damaged as error:
            if lost is None:
                lost, reason = pos, str(error)
            m = _version.search(plain, pos + 1)
            pos = m.start() if m else len(plain)
            continue
        if lost is not None:
            yield Gap(at, pos - lost, reason, lost)
            lost = None
        yield found
        pos = end
    if lost is not None:
        yield Gap(at, len(plain) - lost, reason, lost)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All intact records of an archive, and the gaps between them, in file order."""
    at, n = 0, len(data)
    lost, reason = None, ""
    kept: list[Record] = []  # those of damaged members since the last sound place, which may lie there as plain bytes too
    while at < n:
        records: list[Record | Gap] = []
        try:
            if data.startswith(GZIP, at):
                plain, end, wrong = _inflate(data, at)
                records = list(_records_within(plain, at, wrong is None))
                if wrong is not None:
                    raise Damaged(wrong)
                if records and not any(isinstance(x, Record) for x in records):
                    raise Damaged(records[0].reason)
            elif data.startswith(b"WARC/1.", at):
                found, end = parse_record(data, at, at)
                records = [found]
                if any(found.headers == x.headers and found.block == x.block for x in kept):
                    at = end
                    continue
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as error:
            if lost is None:
                lost, reason = at, str(error)
            kept += [x for x in records if isinstance(x, Record)]
            yield from (x for x in records if isinstance(x, Record))
            m = _candidate.search(data, at + 1)
            at = m.start() if m else n
            continue
        if lost is not None:
            yield Gap(lost, at - lost, reason)
            lost, kept = None, []
        yield from records
        at = end
    if lost is not None:
        yield Gap(lost, n - lost, reason)


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _slots(digests: pd.Series, bits: int) -> np.ndarray:
    """Bit numbers of hex SHA-1 digests, one row each: words of the digest itself."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), ">u4").reshape(-1, 5)[:, :FILTER_HASHES]
    return raw.astype(np.int64) & (bits - 1)


def may_repeat(copies: DataFrame, n: int) -> Column:
    """A condition on ``digest`` that holds for all digests of ``copies`` (``n`` rows) and few others.

    The filter has 16 bits for each digest up to ``FILTER_BITS`` in all. Set bits are merged into words before they
    leave their tasks, so at most ``FILTER_BITS / 32`` words reach the driver.
    """
    spark = copies.sparkSession
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))

    @F.pandas_udf("array<long>")
    def slots(digests: pd.Series) -> pd.Series:
        return pd.Series(list(_slots(digests, bits))) if len(digests) else pd.Series([], dtype=object)

    words = copies.select(F.explode(slots("digest")).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word"))
    merged = words.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS int))) AS mask")).toArrow()
    field = np.zeros(bits // 32, np.uint32)
    field[merged.column("word").to_numpy()] = merged.column("mask").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def all_set(digests: pd.Series) -> pd.Series:
        if not len(digests):
            return pd.Series([], dtype=bool)
        at = _slots(digests, bits)
        return pd.Series((sent.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).all(axis=1).astype(bool))

    return all_set("digest")


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> str:
    """Write one record per row below ``path`` (default: a new folder in the shared one); returns the path."""
    spark = pages.sparkSession
    workers_can_import(spark)
    path = path or shared_path(spark, "warc")
    rows = pages.select(
        F.col(_quoted(id_col)).cast("long").alias("page_id"), F.col(_quoted(url_col)).cast("string").alias("url"),
        F.coalesce(F.col(_quoted(html_col)).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    large = F.octet_length("payload") >= min_revisit
    keyed = rows.where(large).withColumn("digest", F.sha1("payload"))
    counted = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keeper"))
    copies = materialize(counted.where("n > 1 AND keeper IS NOT NULL"), "payloads")
    known = copies.agg(F.count(F.lit(1)).alias("digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    columns = ["page_id", "url", "payload", "keeper"]
    alone = F.lit(None).cast("long").alias("keeper")
    maybe = may_repeat(copies, known["digests"])
    joined = join_unique(keyed.where(maybe), copies, "digest", "n", known["rows"]).select(*columns)
    decided = joined.unionByName(keyed.where(~maybe).select("page_id", "url", "payload", alone)).unionByName(rows.where(~large).select("page_id", "url", "payload", alone))
    decided = decided.withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                (r,) = batch.slice(k, 1).to_pylist()
                held.append(member(record(r["page_id"], r["url"], r["payload"], r["keeper"], r["revisit"])))
                size += len(held[-1])
                if size >= RUN_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    members = decided.select(*columns, "revisit").mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", RUNS_PER_FILE).option("compression", "none").text(path)
    return path


_READ = "file string, byte_offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, gap_bytes long, gap_reason string, gap_inside long"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every intact record below ``path`` and every quarantined gap (``gap_bytes`` is not null there).

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: measured for responses (a record whose
    payload differs from its digest is quarantined), as recorded for revisits. ``gap_inside``: see :class:`Gap`.
    """
    workers_can_import(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        for x in salvage(data):
            if isinstance(x, Gap):
                yield name, x.offset, None, None, None, None, None, None, None, x.length, x.reason, x.inside
                continue
            kind = x.headers.get("WARC-Type")
            claimed = x.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
            url = x.headers.get("WARC-Target-URI")
            length, body = x.payload()
            if kind == "response":
                digest = hashlib.sha1(body).hexdigest()
                if (claimed and claimed != digest) or length != len(body):
                    yield name, x.offset, x.number("WARC-Record-ID"), None, None, None, None, None, None, 0, "payload digest or length differs", None
                    continue
            else:
                digest = claimed
            yield name, x.offset, x.number("WARC-Record-ID"), None if url == NO_URL else url, kind, x.number("WARC-Refers-To"), length, digest, body if payloads and kind == "response" else None, None, None, None

    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held: list[tuple] = []
                size = 0
                for row in rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes()):
                    held.append(row)
                    size += len(row[8] or b"") + 200
                    if size > 8 << 20:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    def pack(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(types)], names=names)

    return files.mapInArrow(run, _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives and read them back: one row per page. A gap in what was just written is an error."""
    path = write_archives(pages, **options)
    read = read_archives(pages.sparkSession, path, payloads=False)
    broken = F.raise_error(F.concat(F.lit("an archive just written is damaged: "), "file", F.lit(": "), "gap_reason")).cast("boolean")
    return read.where(F.when(F.col("gap_bytes").isNull(), F.lit(True)).otherwise(broken)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
