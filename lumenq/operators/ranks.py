"""Exact ranks inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the parts only; the same in any engine with SHA-256."""
    text = F.concat_ws("|", *(F.lit(str(p)) if isinstance(p, int) else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def hash_unit_sql(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296.0)"


def spread_row_number(frame: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "rn", size: str | None = None) -> DataFrame:
    """``row_number`` in ``group`` by ``order``, where ``bucket`` (an integer) rises with the order.

    Rows are counted by bucket (map-side), the few counts of a group are summed up, and only
    rows of one bucket are sorted together: a group that holds a third of all rows is spread over
    as many tasks as it has buckets. ``size`` names a column for the group's row count.
    """
    held = frame.withColumn("bucket__", bucket)
    keys = [F.col(g).alias(f"{g}__") for g in group]
    counts = held.groupBy(*keys, F.col("bucket__").alias("b__")).agg(F.count(F.lit(1)).alias("n__"))
    names = [f"{g}__" for g in group]
    before = Window.partitionBy(*names).orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before__", F.coalesce(F.sum("n__").over(before), F.lit(0))).withColumn("size__", F.sum("n__").over(Window.partitionBy(*names)))
    same = F.col("bucket__").eqNullSafe(F.col("b__"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    joined = held.join(counts, same)
    local = F.row_number().over(Window.partitionBy(*group, "bucket__").orderBy(*order))
    out = joined.withColumn(name, (local + F.col("before__")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("size__"))
    return out.drop(*names, "bucket__", "b__", "n__", "before__", "size__")
