"""Population metrics: every one is a plain aggregation over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.operators.ranks import spread_row_number

THRESHOLDS = [k / 10 for k in range(11)]


def correctness(facts: DataFrame, confidence: str = "max_prob", temperature: float = 1.0, floor: float = dist.FLOOR) -> DataFrame:
    """Facts with the distribution at ``temperature``, ``conf`` and ``correct`` (0 or 1)."""
    applied = facts.withColumn("p", dist.sharpen(F.col("p"), temperature, floor))
    return applied.withColumn("conf", dist.confidence(F.col("p"), confidence)).withColumn("correct", (dist.argmax(F.col("p")) == F.col("y")).cast("double"))


def checked(facts: DataFrame) -> DataFrame:
    """Facts whose label must be one of the options; any other row is an error."""
    bad = F.col("y").isNull() | (F.col("y") < 0) | (F.col("y") >= F.size("p"))
    return facts.withColumn("y", F.when(bad, F.raise_error(F.lit("a label isn't one of the options")).cast("int")).otherwise(F.col("y")))


def scores(facts: DataFrame, by: list[str], temperature: float = 1.0) -> DataFrame:
    """Count, accuracy, Brier, NLL and RPS of each group; one scan, one small shuffle."""
    rows = correctness(facts, temperature=temperature)
    p, y = F.col("p"), F.col("y")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("correct").alias("accuracy"),
        F.avg(dist.brier(p, y)).alias("brier"),
        F.avg(dist.nll(p, y)).alias("nll"),
        F.avg(dist.rps(p, y)).alias("rps"),
        F.avg(dist.entropy(p)).alias("entropy"),
    )


def bin_of(conf: Column, bins: int) -> Column:
    """Equal-width bin: truncation of the quotient by the width, 1.0 in the top bin."""
    return F.least((conf / F.lit(1.0 / bins)).cast("int"), F.lit(bins - 1))


def reliability(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """All equal-width bins of each group, empty ones with zeros: ``lo``, ``hi``, ``count``, ``confidence``, ``accuracy``."""
    found = rows.groupBy(*by, bin_of(F.col("conf"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg("conf").alias("confidence"), F.avg("correct").alias("accuracy"))
    # The bins of the groups that occur: made from the small aggregate, nothing is crossed with data.
    grid = found.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(found, [*by, "bin"], "left")
    return full.select(*by, "bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "confidence", "accuracy")))


def ece(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins."""
    found = rows.groupBy(*by, bin_of(F.col("conf"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.sum("conf").alias("s"), F.sum("correct").alias("a"))
    return found.groupBy(*by).agg((F.sum(F.abs(F.col("a") - F.col("s"))) / F.sum("c")).alias("ece"))


def equal_mass(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Rows with ``chunk``: ``bins`` parts of equal size by confidence (ties by id), larger ones first."""
    ranked = spread_row_number(rows, by, F.floor(F.col("conf") * 4096), [F.col("conf"), F.col("id")], "rn", "size")
    many = F.least(F.lit(bins), F.col("size"))
    share, larger = F.floor(F.col("size") / many), F.col("size") % many
    border = larger * (share + 1)
    at = F.col("rn") - 1
    chunk = F.when(at < border, F.floor(at / (share + 1))).otherwise(larger + F.floor((at - border) / share))
    return ranked.withColumn("chunk", chunk.cast("int"))


def ece_equal_mass(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    found = equal_mass(rows, by, bins).groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("c"), F.sum("conf").alias("s"), F.sum("correct").alias("a"))
    return found.groupBy(*by).agg((F.sum(F.abs(F.col("a") - F.col("s"))) / F.sum("c")).alias("ece_mass"))


def selective(rows: DataFrame, by: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """Coverage, and accuracy of what is at or above each threshold (null if nothing is); one scan."""
    cuts = THRESHOLDS if thresholds is None else thresholds
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(x for k, t in enumerate(cuts) for x in (F.count_if(F.col("conf") >= t).alias(f"c{k}"), F.sum(F.when(F.col("conf") >= t, F.col("correct"))).alias(f"a{k}"))))
    points = F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col(f"c{k}") / F.col("n")).alias("coverage"), (F.col(f"a{k}") / F.when(F.col(f"c{k}") > 0, F.col(f"c{k}"))).alias("accuracy")) for k, t in enumerate(cuts)))
    return wide.select(*by, F.explode(points).alias("s")).select(*by, "s.*")


def _summed(cells: Column, value: str) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x[value])


def report(facts: DataFrame, by: list[str], bins: int = 10, confidence: str = "max_prob", temperature: float = 1.0, floor: float = dist.FLOOR) -> DataFrame:
    """One row a group: count, accuracy, ECE, Brier, temperature, the bins and the selective curve.

    One scan: everything comes from one aggregate by equal-width bin and threshold band.
    """
    rows = correctness(checked(facts), confidence, temperature, floor)
    cell = rows.withColumn("bin", bin_of(F.col("conf"), bins)).withColumn("band", F.size(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: t <= F.col("conf"))))
    cells = cell.groupBy(*by, "bin", "band").agg(F.count(F.lit(1)).alias("c"), F.sum("conf").alias("s"), F.sum("correct").alias("a"), F.sum(dist.brier(F.col("p"), F.col("y"))).alias("b"))
    parts = cells.groupBy(*by).agg(F.sum("c").alias("count"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.collect_list(F.struct("bin", "band", "c", "s", "a")).alias("cells"))

    def cell_of(k: Column) -> Column:
        def cell(own: Column) -> Column:
            count, conf, right = (_summed(own, v) for v in "csa")
            mean = lambda x: F.coalesce(F.try_divide(x, count), F.lit(0.0))
            return F.struct((k / bins).alias("lo"), ((k + 1) / bins).alias("hi"), count.cast("long").alias("count"), mean(conf).alias("confidence"), mean(right).alias("accuracy"))

        return dist.let(F.filter("cells", lambda x: x["bin"] == k), cell)

    def point_of(threshold: Column, k: Column) -> Column:
        def point(own: Column) -> Column:
            count, right = _summed(own, "c"), _summed(own, "a")
            return F.struct(threshold.alias("threshold"), (count / F.col("count")).alias("coverage"), F.try_divide(right, count).alias("accuracy"))

        return dist.let(F.filter("cells", lambda x: x["band"] > k), point)

    listed = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), cell_of)
    curve = F.transform(F.array(*map(F.lit, THRESHOLDS)), point_of)
    out = parts.withColumn("bins", listed).withColumn("curve", curve)
    gap = F.aggregate("bins", F.lit(0.0), lambda acc, x: acc + x["count"] * F.abs(x["accuracy"] - x["confidence"]))
    return out.select(*by, "count", (F.col("a") / F.col("count")).alias("accuracy"), (gap / F.col("count")).alias("ece"), (F.col("b") / F.col("count")).alias("brier"), F.lit(float(temperature)).alias("temperature"), "bins", "curve")


def accuracy_at_coverage(facts: DataFrame, by: list[str], coverage: float) -> DataFrame:
    """Accuracy of the most confident part by margin; of ties the right answers come first."""
    rows = correctness(facts, "margin")
    ranked = spread_row_number(rows, by, -F.floor(F.col("conf") * 4096), [F.desc("conf"), F.desc("correct"), F.col("id")], "rn", "size")
    keep = F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(coverage)))
    return ranked.where(F.col("rn") <= keep).groupBy(*by).agg(F.count(F.lit(1)).alias("kept"), F.avg("correct").alias("accuracy"))


def score_mae(facts: DataFrame, by: list[str]) -> DataFrame:
    """Mean distance of the expected position (values 1 .. n) from the true one."""
    values = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("double"))
    return facts.groupBy(*by).agg(F.avg(F.abs(dist.expectation(F.col("p"), values) - (F.col("y") + 1))).alias("mae"))


def predicted_classes(facts: DataFrame, by: list[str], top: int) -> DataFrame:
    """The most often predicted options of each group."""
    from pyspark.sql import Window

    counted = facts.groupBy(*by, F.get("options", dist.argmax(F.col("p"))).alias("predicted")).count()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "predicted"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def nearest_rank(frame: DataFrame, by: list[str], value: str, order: str, quantiles: list[float], bucket: Column) -> DataFrame:
    """Truncated nearest-rank percentiles ``sorted[min(n-1, int(q n))]``."""
    ranked = spread_row_number(frame, by, bucket, [F.col(value), F.col(order)], "rn", "size")
    picks = [F.least(F.col("size"), (F.col("size") * F.lit(q)).cast("long") + 1) for q in quantiles]
    return ranked.groupBy(*by).agg(*(F.max(F.when(F.col("rn") == pick, F.col(value))).alias(f"p{round(q * 100)}") for q, pick in zip(quantiles, picks, strict=True)), F.count(F.lit(1)).alias("n"))


def disagreements(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How often only the student, and only the teacher, is right."""
    s, t = dist.argmax(F.col("student")) == F.col("y"), dist.argmax(F.col("teacher")) == F.col("y")
    return pairs.groupBy(*by).agg(F.count_if(s & ~t).alias("student_only_right"), F.count_if(t & ~s).alias("teacher_only_right"))
