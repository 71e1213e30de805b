"""Dense row positions along a sort, without a single-task window.

``row_number() over (order by k)`` (no partition) runs in one task, and
``over (partition by g order by k)`` runs a whole group in one task. Here the
rows are range-partitioned and sorted by ``(g, k)`` (Spark samples the key to
pick the bounds, so one hot ``g`` still spreads over many partitions), each
row gets ``monotonically_increasing_id`` (partition index in the high bits,
row index in the low 33 bits), and a per-partition count table - one row per
partition, so its size is bounded by the partition count - turns that into
a dense global index. Within a group the position is the global index minus
the group's first index (one row per group, aggregated before the join).

The stamped rows are written once as a table (under the session's
``spark.checkpoint.dir``; rows of types that no table holds by ``checkpoint()``): the ids depend on how the sort's
shuffle is read, and adaptive execution may coalesce it differently in the
count branch and the row branch of the plan; reading one written copy keeps
the two consistent and also cuts the lineage, so a lost executor does not
re-run the sort.

The order must be total (add a tie-breaker) for a deterministic result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, kept

_LOW = (1 << 33) - 1


def global_positions(df: DataFrame, order: list[Column], pos_col: str = "pos") -> DataFrame:
    """Add ``pos_col``: 1-based dense position of each row along ``order``."""
    stamped = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    if any(kind in f.dataType.simpleString() for f in df.schema for kind in ("void", "interval")):
        ensure_checkpoint_dir(df.sparkSession)
        stamped = stamped.checkpoint(eager=True)
    else:  # columns go by number, as names may repeat
        stamped = kept(stamped.toDF(*[f"c{i}" for i in range(len(stamped.columns))]), "positions").toDF(*stamped.columns)
    stamped = stamped.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW)))
    counts = stamped.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    # One row per partition: a prefix sum over it is tiny, and it is broadcast
    # because its size is bounded by the number of partitions, not the data.
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    out = stamped.join(F.broadcast(offsets.select("_part", "_off")), "_part")
    return (out.withColumn(pos_col, F.col("_off") + F.col("_idx") + 1)
               .drop("_mid", "_part", "_idx", "_off"))


def group_positions(df: DataFrame, group_cols: list[str], order: list[Column],
                    pos_col: str = "pos") -> DataFrame:
    """Add ``pos_col``: 1-based dense position of each row inside its group along ``order``."""
    full = [F.col(g) for g in group_cols] + list(order)
    g = global_positions(df, full, "_gpos")
    starts = kept(g.groupBy(*group_cols).agg(F.min("_gpos").alias("_start")), "starts")
    return (g.join(starts, group_cols)
             .withColumn(pos_col, F.col("_gpos") - F.col("_start") + 1)
             .drop("_gpos", "_start"))
