"""Which consumer gets a row: at random, by key, all, or by the consistent-hash ring."""

from __future__ import annotations

import hashlib
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ring_key
from .aggregates import replicas


class Route(Enum):
    RANDOM, HASH, ALL = "random", "hash", "all"


def routed(df: DataFrame, route: Route, n: int, key: str | None = None) -> DataFrame:
    """``df`` dealt to ``n`` consumers. HASH needs a key; rows without one go to ``keyless``, not to a consumer."""
    if route is Route.ALL:
        return replicas(df, n)
    if route is Route.HASH:
        if key is None:
            raise ValueError("hash routing needs a key")
        return df.where(F.col(key).isNotNull()).repartition(n, key)
    return df.repartition(n)


def keyless(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull()).withColumn("error", F.lit("no routing key"))


def competing(df: DataFrame, n: int, key: str) -> list[DataFrame]:
    """``n`` disjoint shares of a stream, for consumers that share its messages instead of each getting all."""
    slot = F.pmod(F.xxhash64(key), F.lit(n))
    return [df.where(slot == i) for i in range(n)]


# Fixed values of the ring: digests of a node, and points of a digest.
SLOTS, POINTS = 40, 3


def ring(nodes: dict[str, int], slots: int = SLOTS, points: int = POINTS) -> list[tuple[int, str]]:
    """(point, node) sorted: each node has ``slots`` digests in proportion to its weight, each giving ``points`` points."""
    total = sum(nodes.values())
    found = []
    for node, weight in nodes.items():
        for slot in range(slots * len(nodes) * weight // total):
            digest = hashlib.md5(f"{node}-{slot}".encode()).digest()
            found += [(int.from_bytes(digest[4 * p : 4 * p + 4], "little"), node) for p in range(points)]
    return sorted(found)


def ring_routed(df: DataFrame, key: str, nodes: dict[str, int]) -> DataFrame:
    """``df`` with ``node``: the node of the first ring point above the key's, the first of all past the end.

    The ring is a literal of a few points per node, searched by halves within the row: each halving adds its step to the number of points not above the key.
    """
    table = ring(nodes)
    size = len(table)
    points, names = (F.array(*[F.lit(x[k]) for x in table]) for k in range(2))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])
    position = ring_key(F.col(key))
    step = lambda p: lambda at, half: F.when(F.get(points, at + half - 1) <= p, at + half).otherwise(at)
    at = F.transform(F.array(position), lambda p: F.aggregate(halves, F.lit(0), step(p)))[0]
    return df.withColumn("node", F.get(names, F.pmod(at, F.lit(size))))


def iterate_nodes(nodes: dict[str, int], key: str) -> list[str]:
    """All nodes, each once, in the order in which the ring meets them from the key on."""
    table = ring(nodes)
    position = int.from_bytes(hashlib.md5(key.encode()).digest()[:4], "little")
    at = sum(p <= position for p, _ in table)
    return list(dict.fromkeys(n for _, n in table[at:] + table[:at]))
