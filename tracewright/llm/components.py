"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Parts into which the edges of one node are dealt where they meet its minimum.
SALTS = 8


def _attach_minimum(edges: DataFrame) -> DataFrame:
    """Adds ``m``: the smallest node among u and its neighbours v.

    The minimum is taken before the shuffle and after; each node's minimum is then repeated once
    for each salt, so that the edges of a node with very many neighbours spread over several tasks.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(low, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _attach_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    linked = _attach_minimum(edges)
    return (
        linked.select("u", F.col("m").alias("v"))
        .union(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """One row ``(node, component)`` per node that has a link; component is its smallest node.

    Each round replaces the edges by stars that point to smaller nodes (large star, then small
    star), writes them to the shared folder and deletes those of the round before. It ends when a
    round changes nothing; the number of rounds grows with the logarithm of a component's size. Only
    the count and a checksum of the edges reach the driver. Null endpoints and self links are
    ignored; repeated links are one.
    """
    now = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    now = materialize(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = materialize(_small_star(_large_star(now)), "edges", instead=now)
    else:
        raise RuntimeError("components did not settle")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
