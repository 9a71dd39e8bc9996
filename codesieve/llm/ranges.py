"""Shards by ranges of an integer key, the same ones for the same rows, whatever the cluster."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, SPLIT = 4096, 64


def range_bounds(df: DataFrame, key: str, weight: Column, least: int, most_shards: int = 20_000) -> list[int]:
    """Lower bounds of the second and later shards: contiguous key ranges of about max(least, total / most_shards) weight.

    A histogram of the weight over CELLS equal key ranges is summed in the tasks first. Every cell that holds more than a
    shard is split into SPLIT, again and again: a join with the heavy cells, of which there are at most most_shards, tells
    whose rows are counted anew. No shard is heavier than twice the target but for a single key, which is never split.
    """
    spark = df.sparkSession
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(weight).alias("w")).first()
    if span["lo"] is None:
        return []
    target = max(least, -(-int(span["w"]) // most_shards))
    lo, hi = span["lo"], span["hi"]
    step = max(1, -(-(hi - lo + 1) // CELLS))
    # lo and hi may be so far apart that their difference is no bigint: decimals count the cells of the first level.
    off = F.col(key).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")
    code = F.floor(off / F.lit(step).cast("decimal(20,0)")).cast("bigint")
    rest = (F.col(key) - (F.lit(lo).cast("decimal(38,0)") + code.cast("decimal(38,0)") * F.lit(step).cast("decimal(20,0)"))).cast("bigint")
    rows = df.filter(F.col(key).isNotNull()).select(code.alias("cell"), rest.alias("rest"), weight.alias("w"))
    done: list[tuple[int, int]] = []  # (low, weight)
    counted = rows.groupBy("cell").agg(F.sum("w").alias("w")).collect()  # CELLS rows at most
    cells = {r["cell"]: (lo + r["cell"] * step, int(r["w"])) for r in counted}
    while True:
        low = {c: a for c, (a, w) in cells.items() if w > target and step > 1}
        done += [(a, w) for c, (a, w) in cells.items() if c not in low]
        if not low:
            break
        step = -(-step // SPLIT)
        order = sorted(low)
        heavy = spark.createDataFrame([(c, i) for i, c in enumerate(order)], "cell bigint, number bigint")
        rows = rows.join(F.broadcast(heavy), "cell")  # at most most_shards rows
        rows = rows.select((F.col("number") * SPLIT + F.expr(f"rest div {step}L")).alias("cell"), F.expr(f"rest % {step}L").alias("rest"), "w")
        counted = rows.groupBy("cell").agg(F.sum("w").alias("w")).collect()  # SPLIT rows for each heavy cell
        cells = {r["cell"]: (low[order[r["cell"] // SPLIT]] + r["cell"] % SPLIT * step, int(r["w"])) for r in counted}
    bounds, have = [], 0
    for a, w in sorted(done):
        if have and have + w > target:
            bounds.append(a)
            have = 0
        have += w
    return bounds


def shard_column(df: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """df with a column ``shard``: the range that the key is in (null keys: the first). bounds: at most 40,000 or so."""
    if not bounds:
        return df.withColumn("shard", F.lit(0))
    if len(bounds) <= 512:  # as an expression; more bounds would make it too long
        known = F.array(*(F.lit(int(b)) for b in bounds))
        return df.withColumn("shard", F.coalesce(F.size(F.filter(known, lambda x: x <= F.col(key))), F.lit(0)))

    @F.udf("int", useArrow=True)
    def shard(k):
        return 0 if k is None else bisect_right(bounds, k)

    return df.withColumn("shard", shard(F.col(key)))


def deal(df: DataFrame, n: int) -> DataFrame:
    """df with each shard in a partition of its own: partition ``shard`` of n."""
    return df.repartitionById(max(n, 2), F.col("shard").cast("int"))
