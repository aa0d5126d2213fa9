"""Exactly-once view of messages that were delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.session import materialise

#: Copies differ by less than this many seconds in their time stamp.
SAME_TIME_S = 0.001
#: Cells of SAME_TIME_S that one ranking window holds at most.
CELLS_PER_WINDOW = 65_536


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spacing; text that is no JSON stays as it is, marked."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("raw:"), text))


def _messages(log: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("double")
    return log.select(
        F.col("log_pos").alias("pos"),
        F.col("kind").alias("k"),
        F.col("id").alias("i"),
        F.unhex(F.md5(canonical_json(F.col("outcomes")))).alias("o"),
        ts.alias("t"),
        F.floor(ts / F.lit(SAME_TIME_S)).alias("cell"),
    )


def keepers(log: DataFrame) -> DataFrame:
    """``log_pos`` of the one copy kept of each message with an ``id``.

    Copies have the same ``kind``, ``id`` and JSON-equal ``outcomes`` (or both null), and time
    stamps less than a millisecond apart; chains of such copies are one message, of which the
    smallest ``log_pos`` stays.

    Rows are first folded into cells of one millisecond (a map-side combine, so repeated
    deliveries of one message never meet in one task). Identifiers are then split by their
    aggregated frequency: singletons pass, and only cells of repeated identifiers are ranked,
    in windows of at most ``CELLS_PER_WINDOW`` cells, so that an identifier that holds a third
    of the log is spread over as many windows as it has time ranges.
    A null ``kind``, ``outcomes`` or ``ts`` equals another null one. 128 bits stand for the
    canonical text of ``outcomes``.
    """
    # Written once: frequencies, singletons and repeats read the cells, not the log and its JSON again.
    cells = materialise(
        _messages(log)
        .where(F.col("i").isNotNull())
        .groupBy("k", "i", "o", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"), F.min("t").alias("t0"), F.max("t").alias("t1")),
        "cells",
    )
    frequency = cells.groupBy(F.col("k").alias("fk"), F.col("i").alias("fi")).agg(F.sum("n").alias("f"))
    rated = cells.join(frequency, F.col("k").eqNullSafe(F.col("fk")) & (F.col("i") == F.col("fi")))
    singles = rated.where(F.col("f") == 1).select("pos")
    repeated = rated.where(F.col("f") > 1).withColumn("w", F.floor(F.col("cell") / CELLS_PER_WINDOW))
    message = ["k", "i", "o"]
    # An exchange of its own, so that AQE may split a hot identifier in the join above.
    repeated = repeated.repartition(*message, "w").select(*message, "w", "cell", "t0", "t1", "pos")
    in_window = Window.partitionBy(*message, "w").orderBy("cell")

    def starts(t0: Column, t1: Column, by: Window) -> Column:
        linked = t0 - F.lag(t1).over(by) < F.lit(SAME_TIME_S)
        return F.when(linked, 0).otherwise(1)

    runs = (
        repeated.withColumn("s", starts(F.col("t0"), F.col("t1"), in_window))
        .withColumn("run", F.sum("s").over(in_window.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*message, "w", "run")
        .agg(F.min("cell").alias("c0"), F.max("cell").alias("c1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("pos").alias("pos"))
    )
    # A run may go on in the next window only if it touches the border; these are at most two a window.
    border = (F.pmod("c0", F.lit(CELLS_PER_WINDOW)) == 0) | (F.pmod("c1", F.lit(CELLS_PER_WINDOW)) == CELLS_PER_WINDOW - 1)
    touching = F.coalesce(border, F.lit(False))
    across = Window.partitionBy(*message).orderBy("c0")
    chained = (
        runs.where(touching)
        .withColumn("s", starts(F.col("t0"), F.col("t1"), across))
        .withColumn("chain", F.sum("s").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*message, "chain")
        .agg(F.min("pos").alias("pos"))
        .select("pos")
    )
    return singles.unionByName(runs.where(~touching).select("pos")).unionByName(chained)


def deliver_once(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Every message of the log exactly once, with all its columns.

    ``new`` and ``stored`` have at least ``log_pos`` (unique), ``kind``, ``id``, ``ts`` and
    ``outcomes``; other columns are carried along untouched. Rows with a null ``id`` are never
    copies and always pass. With ``stored`` (messages accepted before) the union of both is
    returned; a new copy of a stored message loses to it when its ``log_pos`` is larger. An
    empty log gives an empty result.
    """
    log = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
    kept = keepers(log).withColumnRenamed("pos", "kept_pos__")
    nameless = log.where(F.col("id").isNull())
    return log.where(F.col("id").isNotNull()).join(kept, F.col("log_pos") == F.col("kept_pos__"), "left_semi").unionByName(nameless)


def repeated_deliveries(log: DataFrame) -> DataFrame:
    """``log_pos`` of every copy that ``deliver_once`` leaves out."""
    kept = keepers(log).withColumnRenamed("pos", "kept_pos__")
    rows = log.where(F.col("id").isNotNull()).select("log_pos")
    return rows.join(kept, F.col("log_pos") == F.col("kept_pos__"), "left_anti")
