"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Training: a bounded sample of labelled texts of each language (``SAMPLE_DOCS`` texts, ``SAMPLE_CHARS``
characters of each, ``TOTAL_CHARS`` in all) is normalised to lower-case letters with single spaces. Each language
gets an interpolated Kneser-Ney model of order ``ORDER`` over characters: raw counts at the highest order,
continuation counts below, one absolute discount per order. Models are arrays of n-gram hashes, sorted, with
log-probabilities and log-back-off weights beside them.

Scoring: every character of the whole text is coded with each model; a text goes to the language of lowest
length-normalised cross-entropy. Looked-up n-grams are remembered in a fixed-size table per worker.

Rejection is calibrated on held-back sample texts: a text is not accepted if its language's model codes it worse
than it codes texts of the nearest other language, by more than ``REJECT_SIGMAS`` standard deviations for its
length. So mixed texts stay, and noise goes. ``score`` is the posterior of the language at a temperature
fitted on the same texts.

Defined results: a null text, or one without letters, is ``und`` with score 0 and is not accepted; ties go to
the language that sorts first; without any labelled text (or in an empty table) everything is ``und``; texts of any
length are coded whole, and the size of the pieces changes nothing; rows that repeat stay, and copies of a text count once
in the sample; columns of the input that have the name of a result are replaced. Labels beyond the ``MAX_LANGUAGES``
most frequent ones are not learned, which bounds the model. The model depends only on the set of labelled texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import workers_can_import
from .columns import texts, with_columns

ORDER = 5
SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS = 800, 2000, 6_000_000
MAX_LANGUAGES = 256
REJECT_SIGMAS = 4.0
#: Nats a character above a language's own mean where there is no other language to compare with.
FOREIGN = 1.5
UNDETERMINED = "und"
#: Characters that are coded at once, and remembered n-grams per worker (a power of two).
SLAB, REMEMBERED = 500_000, 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """For each code point: is it a letter or a mark?"""
    out = np.zeros(0x110000, np.bool_)
    for c in range(0x110000):
        out[c] = unicodedata.category(chr(c))[0] in "LM"
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:200]) or any(map(str.isalpha, text))


def symbols(text: str) -> np.ndarray:
    """Code points of a text: lower case, runs of anything but letters as one space, a space at both ends."""
    return np.concatenate([np.zeros(0, np.uint32), *pieces(text, max(1, len(text)))])


def pieces(text: str, size: int) -> Iterator[np.ndarray]:
    """The symbols of a text, ``size`` characters at a time; none if it has no letters."""
    text = text.lower()
    open_, begun = _SPACE, False  # the last symbol so far; has there been a letter?
    for at in range(0, len(text), size):
        points = np.frombuffer(text[at : at + size].encode("utf-32-le", "replace"), np.uint32)
        points = np.where(_letters()[points], points, _SPACE)
        before = np.concatenate([[open_], points[:-1]])
        points = points[(points != _SPACE) | (before != _SPACE)].astype(np.uint32)
        if not len(points):
            continue
        open_ = points[-1]
        yield points if begun else np.concatenate([[_SPACE], points]).astype(np.uint32)
        begun = True
    if begun and open_ != _SPACE:
        yield np.array([_SPACE], np.uint32)


def gram_hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """``out[n - 1][i]``: hash of the n characters that end at i (fewer at the start of the text)."""
    out, h = [], np.zeros(len(points), np.uint64)
    p = points.astype(np.uint64) + np.uint64(1)
    for n in range(order):
        shifted = np.zeros_like(p)
        shifted[n:] = p[: max(0, len(p) - n)]
        h = (h ^ (shifted + np.uint64(n << 32))) * _M1
        h ^= h >> np.uint64(31)
        h = h * _M2
        out.append(h)
    return out


class SortedTable:
    """Hashes in ascending order with values beside them; looked up by their leading bits, then by bisection."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found) of each key."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), np.bool_)


class KneserNey:
    """Interpolated Kneser-Ney over characters for one language."""

    def __init__(self, samples: list[np.ndarray], order: int = ORDER):
        self.order = order
        joined = [s for s in samples if len(s) > 1]
        grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        hashes = [gram_hashes(s, order) for s in joined]
        # the gram of n characters that ends at i, its context (n - 1 characters before i), and the gram without its oldest character
        for n in range(1, order + 1):
            valid = [slice(n - 1, None) for _ in joined]
            gram = _cat([h[n - 1][v] for h, v in zip(hashes, valid, strict=True)])
            context = _cat([h[n - 2][n - 2 : len(h[n - 2]) - 1] for h in hashes]) if n > 1 else np.zeros(len(gram), np.uint64)
            shorter = _cat([h[n - 2][n - 1 :] for h in hashes]) if n > 1 else np.zeros(len(gram), np.uint64)
            unique, first, counts = np.unique(gram, return_index=True, return_counts=True)
            grams.append((unique, context[first], shorter[first], counts))
        vocabulary = max(2, len(grams[0][0])) + 1
        self.uniform = float(np.log(1.0 / (vocabulary + 1000)))
        self.tables: list[SortedTable] = []
        self.backoffs: list[SortedTable] = []
        lower: np.ndarray | None = None
        for n in range(1, order + 1):
            unique, context, shorter, counts = grams[n - 1]
            if n < order and len(grams[n][0]):  # continuation counts: distinct characters before the gram
                above = grams[n][2]
                kinds, kind_counts = np.unique(above, return_counts=True)
                counts = np.maximum(1, kind_counts[np.minimum(np.searchsorted(kinds, unique), len(kinds) - 1)] * (kinds[np.minimum(np.searchsorted(kinds, unique), len(kinds) - 1)] == unique))
            ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            contexts, inverse = np.unique(context, return_inverse=True)
            totals = np.bincount(inverse, counts, len(contexts))
            kinds_after = np.bincount(inverse, minlength=len(contexts))
            weight = discount * kinds_after / np.maximum(totals, 1)
            below = np.exp(self.uniform) if lower is None else lower[np.searchsorted(grams[n - 2][0], shorter)]
            p = np.maximum(counts - discount, 0) / totals[inverse] + weight[inverse] * below
            lower = p
            self.tables.append(SortedTable(unique, np.log(p).astype(np.float32)))
            self.backoffs.append(SortedTable(contexts, np.log(np.maximum(weight, 1e-9)).astype(np.float32)))

    def log_probability(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Natural log of P(character | context); ``grams[n - 1]``, ``contexts[n - 1]``: hashes of the n and n - 1 characters."""
        out = np.full(len(grams[0]), self.uniform, np.float32)
        back = np.zeros(len(out), np.float32)
        todo = np.arange(len(out))
        for n in range(self.order, 0, -1):
            at, found = self.tables[n - 1].look(grams[n - 1][todo])
            hit = todo[found]
            out[hit] = self.tables[n - 1].values[at[found]] + back[hit]
            todo = todo[~found]
            if not len(todo):
                return out
            at, known = self.backoffs[n - 1].look(contexts[n - 1][todo])
            back[todo[known]] += self.backoffs[n - 1].values[at[known]]
        out[todo] = self.uniform + back[todo]
        return out


def _cat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class LanguageModels:
    """The models of all languages, with calibration; small and of bounded size, so it is broadcast."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.models: list[KneserNey] = []
        held: list[tuple[int, np.ndarray]] = []
        for k, language in enumerate(self.languages):
            prepared = [s for s in map(symbols, samples[language]) if len(s)]
            back = prepared[::10] if len(prepared) >= 20 else []
            held += [(k, s) for s in back]
            self.models.append(KneserNey([s for i, s in enumerate(prepared) if not back or i % 10]))
        self._calibrate(held)

    def _calibrate(self, held: list[tuple[int, np.ndarray]]) -> None:
        """Mean and spread of a character's code length per language, and the temperature of the posterior."""
        self.mean, self.spread, self.per_text = (np.full(len(self.models), x) for x in (2.5, 2.0, 0.3))
        self.foreign = self.mean + FOREIGN
        coder = Coder(self)
        results = [(k, coder.losses(s), len(s)) for k, s in held]
        for k in range(len(self.models)):
            own = [(np.sum(x[:, k]) / len(x), len(x)) for j, x, _ in results if j == k]
            each = [x[:, k] for j, x, _ in results if j == k]
            if len(own) >= 2:
                every = np.concatenate(each)
                means = np.array([m for m, _ in own])
                self.mean[k], self.spread[k] = float(every.mean()), float(every.std()) + 0.05
                self.per_text[k] = float(means.std()) + 0.02
            others = [float(np.mean([x[:, k].mean() for i, x, _ in results if i == j])) for j in {i for i, _, _ in results} - {k}]
            self.foreign[k] = max(self.mean[k], min(others, default=self.mean[k] + FOREIGN))
        scores = [(k, -x.sum(0) / np.sqrt(len(x))) for k, x, _ in results]
        best = None
        for t in (0.5, 1.0, 2.0, 4.0, 8.0):
            loss = -sum(float(s[k] / t - _log_sum(s / t)) for k, s in scores)
            if best is None or loss < best[0]:
                best = (loss, t)
        self.temperature = best[1] if scores else 1.0

    def limit(self, k: int, n: int) -> float:
        """The highest accepted cross-entropy of a text of n characters."""
        return float(self.foreign[k] + REJECT_SIGMAS * np.sqrt(self.spread[k] ** 2 / n + self.per_text[k] ** 2))


def _log_sum(x: np.ndarray) -> float:
    m = x.max()
    return float(m + np.log(np.exp(x - m).sum()))


class Coder:
    """Code lengths under all models, with a fixed-size memory of n-grams."""

    def __init__(self, models: LanguageModels, remembered: int = REMEMBERED):
        self.models = models.models
        size = remembered
        while size > 1 << 12 and size * len(self.models) > 16 << 20:
            size >>= 1
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, np.uint64)
        self.values = np.zeros((size, max(1, len(self.models))), np.float32)

    def losses(self, points: np.ndarray) -> np.ndarray:
        """Nats of each character but the first, one column per model."""
        hashes = gram_hashes(points, ORDER)
        key = hashes[ORDER - 1][1:] | np.uint64(1)
        slot = ((key >> np.uint64(20)) & self.mask).astype(np.int64)
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            unique, first = np.unique(key[missing], return_index=True)
            at = missing[first] + 1
            grams = [h[at] for h in hashes]
            contexts = [np.zeros(len(at), np.uint64), *(h[at - 1] for h in hashes[: ORDER - 1])]
            computed = np.stack([m.log_probability(grams, contexts) for m in self.models], 1)
            self.keys[slot[at - 1]] = unique
            self.values[slot[at - 1]] = computed
            out = self.values[slot]
            wrong = np.flatnonzero(self.keys[slot] != key)  # two n-grams of this piece share a slot
            if len(wrong):
                out[wrong] = computed[np.searchsorted(unique, key[wrong])] if np.isin(key[wrong], unique).all() else self._again(hashes, wrong + 1)
            return -out
        return -self.values[slot]

    def _again(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        grams = [h[at] for h in hashes]
        contexts = [np.zeros(len(at), np.uint64), *(h[at - 1] for h in hashes[: ORDER - 1])]
        return np.stack([m.log_probability(grams, contexts) for m in self.models], 1)

    def totals(self, text: str) -> tuple[np.ndarray, int]:
        """(nats of the whole text under each model, coded characters); long texts go in overlapping pieces."""
        total, n = np.zeros(max(1, len(self.models))), 0
        carry = np.zeros(0, np.uint32)
        for part in pieces(text, SLAB):
            whole = np.concatenate([carry, part])
            if len(whole) > 1:
                fresh = self.losses(whole)[max(0, len(carry) - 1) :]
                total += fresh.sum(0, dtype=np.float64)
                n += len(fresh)
            carry = whole[-(ORDER - 1) :]
        return total, n


class Identifier:
    """(language, score, cross-entropy, accepted) of texts."""

    def __init__(self, models: LanguageModels):
        self.models, self.coder = models, Coder(models)

    def __call__(self, text: str | None) -> tuple[str, float, float | None, bool]:
        if not text or not self.models.languages or not has_letter(text):
            return UNDETERMINED, 0.0, None, False
        total, n = self.coder.totals(text)
        if not n:
            return UNDETERMINED, 0.0, None, False
        k = int(np.argmin(total))
        scores = -total / np.sqrt(n) / self.models.temperature
        entropy = float(total[k] / n)
        return self.models.languages[k], float(np.exp(scores[k] - _log_sum(scores))), entropy, entropy <= self.models.limit(k, n)


def sample(labelled: DataFrame, lang_col: str, text_col: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, total: int = TOTAL_CHARS) -> dict[str, list[str]]:
    """A bounded sample of texts of each language: rows are chosen by the hash of their text."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    h = F.xxhash64("text", F.lit(17))
    texts_ = F.approx_count_distinct(h).alias("texts")  # copies of a text count once
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), texts_).orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return {}
    docs = max(1, min(docs, total // chars // len(sizes)))
    # a share of each language's texts that gives about twice the wanted ones; the least hashes of them are kept
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, (2.0 * docs + 30.0) / max(1, r["texts"])))])
    u = F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    length = F.length("text")
    start = F.when(length > chars, F.pmod(F.xxhash64("text", F.lit(18)), length - chars + 1)).otherwise(0).cast("int") + 1
    drawn = rows.withColumns({"__u": u, "__share": F.element_at(share, F.col("lang"))}).where("__share IS NOT NULL AND __u < __share")
    drawn = drawn.select("lang", F.col("__u").alias("u"), F.substring(F.col("text"), start, F.lit(chars)).alias("text")).distinct()
    picked: dict[str, list[tuple[float, str]]] = {}
    for r in drawn.toLocalIterator():  # about twice the sample, all distinct; never more than the bound is held
        mine = picked.setdefault(r["lang"], [])
        mine.append((r["u"], r["text"]))
        if len(mine) >= 4 * docs:
            mine.sort()
            del mine[2 * docs :]
    return {lang: [t for _, t in sorted(mine)[:docs]] for lang, mine in picked.items()}


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModels:
    """Models from the labelled rows; the sample's bounds are this module's parameters."""
    return LanguageModels(sample(labelled, lang_col, text_col))


@lru_cache(maxsize=2)
def _identifier(key: str, holder: "_Held") -> Identifier:
    return Identifier(holder.value)


class _Held:
    """A broadcast's value, compared by name so that a worker builds its identifier once."""

    def __init__(self, name: str, value: LanguageModels):
        self.name, self.value = name, value

    def __eq__(self, other):
        return isinstance(other, _Held) and other.name == self.name

    def __hash__(self):
        return hash(self.name)


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def identify(df: DataFrame, models: LanguageModels, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with ``lang_pred``, ``score``, ``cross_entropy`` and ``accepted``."""
    import uuid

    workers_can_import(df.sparkSession)
    shipped, name = df.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    def make():
        of = _identifier(name, _Held(name, shipped.value))

        def compute(column: pa.Array) -> list[pa.Array]:
            rows = [of(t) for t in texts(column)]
            return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]

        return compute

    return with_columns(df, text_col, ADDED, make, keep)


def in_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
