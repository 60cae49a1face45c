"""Anti-entropy as batch joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import digest
from .ring import REPLICAS, Ring, place


def missing(peer: DataFrame, mine: DataFrame) -> DataFrame:
    """Pairs that the peer has and we lack."""
    return peer.join(mine.select("key"), "key", "left_anti")


def owned(peer: DataFrame, mine: DataFrame, ring: Ring, me: str, count: int = REPLICAS) -> DataFrame:
    """Pairs that we lack and of which we should hold a replica."""
    return place(missing(peer, mine), ring, count).where(F.array_contains("replicas", me)).select("key", "value")


def gated(peer: DataFrame, mine: DataFrame, ring: Ring, me: str, count: int = REPLICAS) -> DataFrame:
    """The pairs of :func:`owned`, or none where the digests of both key sets are equal or one of them is empty.

    Only the roots are compared first; the pairs are looked at only where they differ.
    """
    if digest.compare(mine, peer).first()["skip"]:
        return peer.select("key", "value").limit(0)
    return owned(peer, mine, ring, me, count)


def repair(peer: DataFrame, mine: DataFrame, ring: Ring, me: str, count: int = REPLICAS) -> DataFrame:
    """Our pairs after the repair."""
    return mine.select("key", "value").unionByName(owned(peer, mine, ring, me, count))
