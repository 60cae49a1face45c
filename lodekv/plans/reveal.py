"""REVEAL plans: point, list, prefix and full reads of a state ``(key, value)``; pages and page search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.replay import SENT_PAIRS

#: A listed request of at most this many keys is pushed to the scan as a literal list.
LITERAL_KEYS = 1000
PAGE, MAX_PAGE = 20, 500


def request(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The request as rows ``(pos, key)``: order and repetitions are kept."""
    return spark.createDataFrame(list(enumerate(keys)), "pos int, key string")


def reveal_keys(state: DataFrame, keys: list[str]) -> DataFrame:
    """``pos, key, value, found`` for each requested key, in request order.

    The state is reduced to the requested keys first (pushed into the scan), so that the outer join meets a
    table no larger than the request.
    """
    return reveal_requests(hits_of(state, sorted(set(keys))), request(state.sparkSession, keys), reduced=True)


def hits_of(state: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of distinct ``keys``: by a pushed condition for few of them, by a semi-join for more."""
    if len(keys) <= LITERAL_KEYS:
        return state.where(F.col("key").isin(keys)) if keys else state.where(F.lit(False))
    listed = request(state.sparkSession, keys).select("key")
    return state.join(F.broadcast(listed) if len(keys) <= SENT_PAIRS else listed, "key", "left_semi")


def reveal_requests(state: DataFrame, asked: DataFrame, reduced: bool = False) -> DataFrame:
    """As :func:`reveal_keys` for requests that are a table ``(pos, key)`` of any size."""
    hits = state if reduced else state.join(asked.select("key").distinct(), "key", "left_semi")
    return asked.join(hits.withColumn("found", F.lit(True)), "key", "left").select("pos", "key", "value", F.coalesce("found", F.lit(False)).alias("found")).orderBy("pos")


def reveal_prefix(state: DataFrame, prefix: str) -> DataFrame:
    """``key, value`` of the keys that begin with ``prefix``, by key; no filter at all for the empty prefix."""
    hits = state.where(F.col("key").startswith(prefix)) if prefix else state
    return hits.select("key", "value").orderBy("key")


def window_of(offset: int | None = None, limit: int | None = None) -> tuple[int, int]:
    """Offset at least 0 (default 0); limit 1 to 500 (default 20)."""
    return max(0, offset or 0), min(MAX_PAGE, max(1, PAGE if limit is None else limit))


def keys_page(state: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """One page of keys in byte order."""
    skip, take = window_of(offset, limit)
    return state.select("key").orderBy("key").offset(skip).limit(take)


def page_with_values(state: DataFrame, offset: int | None = None, limit: int | None = None) -> DataFrame:
    """One page of keys with their values: a top-k of keys alone first, then the values of these keys."""
    page = keys_page(state, offset, limit)
    return state.join(F.broadcast(page), "key", "left_semi").select("key", "value").orderBy("key")  # at most MAX_PAGE keys


def search(page: DataFrame, text: str) -> DataFrame:
    """Rows of a page whose key or value contains ``text`` in any case."""
    needle = text.lower()
    return page.where(F.lower("key").contains(needle) | F.lower("value").contains(needle))
