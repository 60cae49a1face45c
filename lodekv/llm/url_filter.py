"""URL filters by a Bloom filter cascade, with DataFrame functions only.

A rule is a host (and all its subdomains) and a path prefix. A URL can only be listed under one of its
candidate keys: its last k host labels, for every k that some rule has, followed by the first n characters
of its path, for every n that some rule's path has. All candidate keys of the whole corpus are the key universe.

One cascade holds the block rules, one the allow rules. Level 1 is a Bloom filter of the listed keys; level 2
one of those keys of the universe that level 1 takes for listed although they aren't; level 3 one of the
listed keys that level 2 takes for unlisted, and so on until a level has no false positive left. Over the
universe the answer is exact: no key is compared, no table joined. The filters grow with the rules and the
logarithm of the universe, not with the corpus; their size is checked before they go into the plan.

Levels are built from one pass that reduces the corpus to its distinct candidate keys. If level 1 is too
large for a plan (``max_bits``), the keys are split by hash into slices, each slice with filters of its own.

Defined results: a null URL, or one without ``://``, has an empty host and path and so no rule; repeated
pages stay; with no rules every page gets the default verdict; null, repeated or contradictory rules: null
ones are ignored, repeated ones count once, a key that is both allowed and blocked is blocked; an empty table gives no
rows; URLs of any length are read whole; columns of the pages that have the name of a result are replaced, others stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

#: Bits of one filter in the plan: 1 MiB of 64-bit words.
MAX_BITS = 1 << 23
#: Levels; each leaves about half of the keys, so that 64 are never needed. Kept as a guard against a defect.
MAX_LEVELS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def candidates(host: Column, path: Column, rules: list[str]) -> Column:
    """Keys under which a URL could be listed, longest first, ties by the longer host; null where it has none."""
    shapes = {(split_rule(r)[0].count(".") + 1, len(split_rule(r)[1])) for r in rules}
    labels = F.split(host, r"\.")
    keys = [
        F.when((F.size(labels) >= k) & (F.length(path) >= n) & (host != ""), F.concat(F.array_join(F.slice(labels, F.size(labels) - (k - 1), k), "."), F.substring(path, 1, n)))
        for k, n in sorted(shapes)
    ]
    if not keys:
        return F.array().cast("array<string>")
    by_length = F.sort_array(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.length(c).alias("n"), F.length(F.substring_index(c, "/", 1)).alias("h"), c.alias("key"))) for c in keys])), asc=False)
    return F.array_distinct(F.transform(by_length, lambda s: s["key"]))


class Bloom:
    """One level: ``m`` bits, ``k`` hash functions, and the words of the bits that are set."""

    def __init__(self, level: int, m: int, k: int, words: dict[int, int]):
        self.level, self.m, self.k, self.words = level, m, k, words

    @staticmethod
    def shape(keys: int, universe: int, first: bool) -> tuple[int, int]:
        """Bits and hash functions: level 1 lets about as many strangers pass as there are keys, later levels half."""
        import math

        rate = min(0.5, max(1e-6, math.sqrt(0.5) * keys / max(universe, 1))) if first else 0.5
        bits = max(64, math.ceil(1.44 * max(keys, 1) * math.log2(1 / rate)))
        return -(-bits // 64) * 64, max(1, round(math.log2(1 / rate)))

    @staticmethod
    def positions(key: Column, level: int, m: int, k: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(m)) for i in range(k)]

    @classmethod
    def build(cls, keys: DataFrame, level: int, m: int, k: int) -> Bloom:
        """The bits of all ``keys`` (column ``key``): set bits are merged by word before they are shuffled."""
        bits = keys.select(F.explode(F.array(*cls.positions(F.col("key"), level, m, k))).alias("p"))
        words = bits.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits"))
        return cls(level, m, k, {r.w: r.bits for r in words.toLocalIterator()})  # at most m / 64 rows

    def test(self, key: Column) -> Column:
        words = ",".join(str(self.words.get(w, 0)) for w in range(self.m // 64))
        table = F.split(F.lit(words), ",").cast("array<bigint>")  # folded to one literal
        hits = [F.getbit(F.get(table, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in self.positions(key, self.level, self.m, self.k)]
        return reduce(lambda a, b: a & b, hits)


class Cascade:
    """Exact membership of listed keys over a universe of keys."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: str, max_bits: int = MAX_BITS, salt: int = 0) -> Cascade:
        """``universe``: distinct ``key`` with a boolean column ``listed``. One small job for each level."""
        inside, outside = (universe.where(F.col(listed)).select("key"), universe.where(~F.col(listed)).select("key"))
        counts = universe.agg(F.count(F.when(F.col(listed), 1)).alias("r"), F.count(F.when(~F.col(listed), 1)).alias("s")).first()
        levels: list[Bloom] = []
        keys, n, others, n_others = inside, counts.r, outside, counts.s
        while n:
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the filter cascade does not converge")
            m, k = Bloom.shape(n, n_others, not levels)
            if m > max_bits:
                raise FilterTooLarge(m)
            level = Bloom.build(keys, salt + len(levels), m, k)
            levels.append(level)
            wrong = others.where(level.test(F.col("key")))
            keys, n, others, n_others = wrong, wrong.count(), keys, n
        return cls(levels)

    def contains(self, key: Column) -> Column:
        """The first level that does not know the key decides: an even number of levels passed means unlisted."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].test(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


class FilterTooLarge(ValueError):
    """A filter of this many bits does not go into a plan."""


class SlicedCascade:
    """A cascade for each slice of the keys by hash, for rule lists beyond the size of one filter."""

    def __init__(self, parts: list[Cascade]):
        self.parts = parts

    @classmethod
    def build(cls, universe: DataFrame, listed: str, max_bits: int = MAX_BITS) -> SlicedCascade:
        slices = 1
        while True:
            try:
                if slices == 1:
                    return cls([Cascade.build(universe, listed, max_bits)])
                mine = lambda i: universe.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(slices)) == i)  # noqa: B023, E731
                return cls([Cascade.build(mine(i), listed, max_bits) for i in range(slices)])
            except FilterTooLarge as e:
                slices *= max(2, -(-e.args[0] // max_bits))
                if slices > 64:
                    raise

    def contains(self, key: Column) -> Column:
        if len(self.parts) == 1:
            return self.parts[0].contains(key)
        at = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.parts)))
        answer = F.lit(False)
        for i, part in enumerate(self.parts):
            answer = F.when(at == i, part.contains(key)).otherwise(answer)
        return answer


def filter_urls(pages: DataFrame, block: list[str], allow: list[str], url_col: str = "url", keep: list[str] | None = None, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """``pages`` (its ``keep`` columns, or all) with ``host``, ``path``, ``rule`` and ``verdict``.

    Rules are strings such as ``example.net/en/``. The longest rule that fits decides.
    """
    spark = pages.sparkSession
    block = sorted({r for r in block if r})
    allow = sorted({r for r in allow if r} - set(block))
    rules = block + allow
    names = {"host", "path", "rule", "verdict"}
    kept = ["`" + c.replace("`", "``") + "`" for c in (keep or pages.columns) if c.lower() not in names]
    host, path = host_and_path(pages["`" + url_col.replace("`", "``") + "`"].cast("string"))
    parsed = pages.select(*kept, host.alias("host"), path.alias("path"))
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    key = candidates(F.col("host"), F.col("path"), rules)
    listed = spark.createDataFrame([(r, 2) for r in block] + [(r, 1) for r in allow], "key string, kind int")
    seen = parsed.select(F.explode(key).alias("key"), F.lit(0).alias("kind"))
    universe = seen.unionByName(listed).groupBy("key").agg(F.max("kind").alias("kind"))
    universe = materialize(universe.select("key", (F.col("kind") == 2).alias("blocked"), (F.col("kind") == 1).alias("allowed")), "url-universe")
    blocked, allowed = SlicedCascade.build(universe, "blocked", max_bits), SlicedCascade.build(universe, "allowed", max_bits)
    discard(universe)

    verdicts = F.transform(key, lambda k: F.struct(k.alias("rule"), F.when(blocked.contains(k), F.lit("block")).when(allowed.contains(k), F.lit("allow")).alias("verdict")))
    first = F.get(F.filter(verdicts, lambda v: v["verdict"].isNotNull()), 0)
    return parsed.withColumn("__hit", first).select(*kept, "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))
