"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackworks.llm.shared import forget, stored


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked with the smallest of u and its neighbours."""
    b = _both(e)
    m = b.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return b.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    m = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(m.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges` (u long, v long) to (id, component): the smallest id reachable, for each id with an edge to another.

    Neither adjacency lists nor labels are ever collected: both stars are an aggregate and a join on the same key, whose
    hot keys adaptive execution splits. Each round is written to the shared folder; it ends when two rounds are alike.
    Self-links and nulls count as nothing; an empty table gives an empty table.
    """
    e = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = _print(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        last, e = e, stored(_small_star(_large_star(e)), "stars")
        now = _print(e)
        forget(last)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
