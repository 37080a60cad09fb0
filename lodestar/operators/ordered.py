"""Windows over long ordered groups, without bringing a group into one task.

A window partitioned by a key sorts all rows of that key in one task; a key with a third of all
rows then takes a third of the table. Here rows are numbered over sorted ranges, whatever their
keys, and frames are taken in blocks of numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of one block of a frame.
BLOCK = 10_000
#: Rows (a few for each range) that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place from 1 in a total order: sorted ranges are numbered apart, then shifted by the sizes before them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(rows.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()), "ranges")
    sizes, at = {}, 0
    for r in sorted(ranges.groupBy("part_").count().collect()):  # a row for each range
        sizes[r.part_], at = at, at + r["count"]
    w = Window.partitionBy("part_").orderBy(*order)
    start = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(v))]), F.col("part_")) if sizes else F.lit(0)
    return ranges.withColumn(name, (F.row_number().over(w) + start).cast("long")).drop("part_")


def small(rows: DataFrame) -> DataFrame:
    """Written rows, sent to all executors where they are few."""
    rows = written(rows, "small")
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def placed(rows: DataFrame, by: str, order: list) -> DataFrame:
    """``rows`` with ``i_`` (place from 1 in its group) and ``n_`` (size of the group)."""
    all_ = written(numbered(rows, [by, *order], "at_"), "numbered")
    sizes = small(all_.groupBy(by).agg(F.min("at_").alias("first_"), F.count("*").alias("n_")))
    out = all_.join(sizes.withColumnRenamed(by, "by_"), F.col(by).eqNullSafe(F.col("by_"))).drop("by_")
    return out.withColumn("i_", F.col("at_") - F.col("first_") + 1).drop("at_", "first_")


def framed(rows: DataFrame, by: str, order: list, back: int, columns: dict, until: int = 0, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``columns`` (name -> function of a window) over frames of ``back`` rows before to ``until``.

    The last ``back`` rows of each block of numbers are copied to the next one, so a frame never
    leaves its block. ``until`` is 0 (the row itself) or negative.
    """
    if back >= block:
        raise ValueError("the frame is longer than a block")
    all_ = numbered(rows, [by, *order], "at_")
    own = F.floor(F.col("at_") / block)
    tail = F.col("at_") % block >= block - back
    copies = F.when(tail, F.array(F.struct(own.alias("block_"), F.lit(True).alias("own_")), F.struct((own + 1).alias("block_"), F.lit(False).alias("own_"))))
    dealt = all_.select("*", F.explode(F.coalesce(copies, F.array(F.struct(own.alias("block_"), F.lit(True).alias("own_"))))).alias("b_")).select("*", "b_.*").drop("b_")
    base = Window.partitionBy("block_", by).orderBy("at_")
    w = base.rowsBetween(-back, until)
    out = dealt.select("*", *[f(w).alias(name) for name, f in columns.items()])
    return out.where("own_").drop("at_", "block_", "own_")


def running(rows: DataFrame, by: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums from the first row of each group: sums inside blocks, and those of the blocks before."""
    all_ = numbered(rows, [by, *order], "at_").withColumn("block_", F.floor(F.col("at_") / BLOCK))
    all_ = written(all_.select("*", *[c.alias(f"x_{n}") for n, c in sums.items()]), "numbered")
    total = all_.groupBy(by, "block_").agg(*[F.sum(f"x_{n}").alias(f"t_{n}") for n in sums])  # a row for each block, and one more for each group
    before = Window.partitionBy(by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    total = small(total.select(F.col(by).alias("by_"), F.col("block_").alias("k_"), *[F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"s_{n}") for n in sums]))
    w = Window.partitionBy("block_", by).orderBy("at_").rowsBetween(Window.unboundedPreceding, 0)
    inside = all_.select("*", *[F.sum(f"x_{n}").over(w).alias(f"w_{n}") for n in sums])
    out = inside.join(total, F.col(by).eqNullSafe(F.col("by_")) & (F.col("block_") == F.col("k_")))
    return out.select(*rows.columns, *[(F.col(f"w_{n}") + F.col(f"s_{n}")).alias(n) for n in sums])
