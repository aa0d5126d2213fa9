"""Routing between heads and the teacher, and admission control, over tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions import dist
from lumenq.operators.ranks import spread_row_number

TEACHER = "teacher"
#: Rows of a key that one window of trailing means holds at most, but for the lead of the block before.
BLOCK_STEPS = 65_536
#: Seconds of the sliding window of the rate limit.
WINDOW_S = 60.0
#: Recent requests that outcomes are checked against.
RECENT = 100_000


def registry(heads: DataFrame) -> DataFrame:
    """Heads that may serve: promoted ones, the newest version of each family."""
    newest = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("version")))
    return heads.where("promoted").withColumn("r__", newest).where("r__ = 1").drop("r__")


def one_head_per_family(heads: DataFrame) -> DataFrame:
    """Heads as they are; two for one family are an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy("family"))
    return heads.withColumn("n__", n).withColumn("family", F.when(F.col("n__") > 1, F.raise_error(F.lit("two heads for one family")).cast("string")).otherwise(F.col("family"))).drop("n__")


def route(requests: DataFrame, heads: DataFrame, shadows: DataFrame, min_confidence: float) -> DataFrame:
    """``served_by`` and ``shadow`` of every asked question.

    ``requests`` has ``family`` and ``head_p`` (what a head says, null if none ran); ``heads``
    and ``shadows`` have ``family`` and ``head``. A registered head serves if its margin is
    ``min_confidence`` or more; any other question goes to the teacher, and then a shadow head
    of the family runs beside it, unless a serving head of the family exists.
    """
    served = heads.select(F.col("family").alias("hf"), F.col("head").alias("serving"))
    beside = shadows.join(heads.select(F.col("family").alias("x__")), F.col("family") == F.col("x__"), "left_anti").select(F.col("family").alias("sf"), F.col("head").alias("beside"))
    joined = requests.join(served, F.col("family") == F.col("hf"), "left").join(beside, F.col("family") == F.col("sf"), "left")
    sure = F.col("serving").isNotNull() & F.col("head_p").isNotNull() & (dist.confidence(F.col("head_p"), "margin") >= min_confidence)
    out = joined.withColumn("served_by", F.when(sure, F.col("serving")).otherwise(F.lit(TEACHER)))
    return out.withColumn("shadow", F.when(F.col("served_by") == TEACHER, F.col("beside"))).drop("hf", "sf", "serving", "beside")


def admit(times: Column, per_minute: int) -> Column:
    """Which of a caller's requests are admitted: an array of booleans beside the sorted times.

    A request is refused if ``per_minute`` admitted ones lie less than a minute back; refused ones
    don't count. ``times`` are seconds in ascending order.
    """
    start = F.struct(F.array().cast("array<double>").alias("hits"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        recent = F.filter(acc["hits"], lambda h: t - h < WINDOW_S)
        ok = F.size(recent) < per_minute
        return F.struct(F.when(ok, F.concat(recent, F.array(t))).otherwise(recent).alias("hits"), F.concat(acc["ok"], F.array(ok)).alias("ok"))

    return F.aggregate(times, start, step, lambda acc: acc["ok"])


def rate_limit(requests: DataFrame, caller: str, ts: str, key: str, per_minute: int) -> DataFrame:
    """``admitted`` and ``retry_after`` (seconds, null if admitted) of each request.

    Admission depends on earlier admissions, so it is a fold in time order. A pause of a minute or
    more clears the window: a caller's requests are first cut at such pauses into spells, which
    are folded side by side, and a caller is never gathered as a whole. Only a caller that never
    pauses for a minute stays one spell; it is folded in a stream by a task that holds no more
    than the last minute's hits.
    """
    import pandas as pd

    # Spells by windows of an hour, so that no window holds a caller: what an hour needs from
    # earlier ones (their last time and last spell) comes from one row an hour.
    hours = requests.withColumn("h__", F.floor(F.col(ts) / 3600.0))
    inside = Window.partitionBy(caller, "h__").orderBy(ts, key)
    ends = hours.groupBy(F.col(caller).alias("c__"), F.col("h__").alias("g__")).agg(F.max(ts).alias("end__"))
    ends = ends.withColumn("last__", F.lag("end__").over(Window.partitionBy("c__").orderBy("g__"))).drop("end__")
    of_hour = F.col(caller).eqNullSafe(F.col("c__")) & (F.col("h__") == F.col("g__"))
    timed = hours.join(ends, of_hour).drop("c__", "g__")
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(inside), F.col("last__")) >= WINDOW_S
    begun = timed.withColumn("begin__", F.when(F.coalesce(gap, F.lit(True)), F.col(ts))).drop("last__")
    opened = begun.groupBy(F.col(caller).alias("c__"), F.col("h__").alias("g__")).agg(F.max("begin__").alias("b__"))
    earlier = Window.partitionBy("c__").orderBy("g__").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("carry__", F.max("b__").over(earlier)).drop("b__")
    latest = F.max("begin__").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    spells = begun.join(opened, of_hour).withColumn("spell__", F.coalesce(latest, F.col("carry__"))).drop("c__", "g__", "h__", "begin__", "carry__")
    ordered = spells.repartition(F.col(caller), F.col("spell__")).sortWithinPartitions(caller, "spell__", ts, key)
    columns = requests.columns
    kinds = dict(requests.dtypes)

    def fold(batches):
        now, hits = None, []
        for b in batches:
            admitted, wait = [], []
            for who, spell, t in zip(b[caller], b.spell__, b[ts], strict=True):
                if (who, spell) != now:
                    now, hits = (who, spell), []
                hits = [h for h in hits if t - h < WINDOW_S]
                if len(hits) < per_minute:
                    hits.append(t)
                    admitted.append(True)
                    wait.append(None)
                else:
                    admitted.append(False)
                    wait.append(max(1, int(WINDOW_S - (t - hits[0])) + 1))
            yield b[columns].assign(admitted=admitted, retry_after=pd.array(wait, dtype="Int32"))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return ordered.mapInPandas(fold, f"{schema}, admitted boolean, retry_after int")


def in_flight(requests: DataFrame, start: str, seconds: float, bucket_s: float = 3600.0) -> DataFrame:
    """Requests of each moment that are still being worked on, if each takes ``seconds``.

    Starts count one up and ends one down; sums run inside time buckets, on top of what the
    buckets before add up to.
    """
    ups = requests.select(F.col(start).alias("t"), F.lit(1).alias("d"))
    downs = requests.select((F.col(start) + seconds).alias("t"), F.lit(-1).alias("d"))
    moves = ups.unionByName(downs).groupBy("t").agg(F.sum("d").alias("d")).withColumn("b", F.floor(F.col("t") / bucket_s))
    ahead = moves.groupBy("b").agg(F.sum("d").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    running = F.sum("d").over(Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return moves.join(ahead, "b").select("t", (running + F.col("before")).alias("in_flight"))


def overloaded(requests: DataFrame, start: str, seconds: float, most: int) -> DataFrame:
    """Moments at which more than ``most`` requests are in flight (an upper bound: refusals are not fed back)."""
    return in_flight(requests, start, seconds).where(F.col("in_flight") > most)


def recent(asks: DataFrame, order: str, most: int = RECENT) -> DataFrame:
    """The last ``most`` asks; a sort with a limit keeps no more than that in any task."""
    return asks.orderBy(F.desc(order)).limit(most)


def callers(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose bearer key is a known one."""
    return requests.join(keys.select(F.col("key").alias("k__")).distinct(), F.col("key") == F.col("k__"), "left_semi")


def null_priors(questions: DataFrame, scorer, key: str = "family") -> DataFrame:
    """The prior of each distinct question, scored once over an empty state and joined where it is needed."""
    return scorer(questions.dropDuplicates([key]))


def trailing_mean(rows: DataFrame, by: list[str], order: str, value: str, steps: int = 20) -> DataFrame:
    """Mean of the last ``steps`` values by ``order`` (an integer), and ``step``, the row's number in its key.

    A key is cut into blocks of BLOCK_STEPS rows, each with the last rows of the block before, so
    that no task sorts a whole key.
    """
    ranked = spread_row_number(rows, by, F.floor(F.col(order) / BLOCK_STEPS), [F.col(order)], "step")
    place = F.col("step") - 1
    own = ranked.withColumn("block__", F.floor(place / BLOCK_STEPS)).withColumn("lead__", F.lit(False))
    lead = ranked.where(place % BLOCK_STEPS > BLOCK_STEPS - steps).withColumn("block__", F.floor(place / BLOCK_STEPS) + 1).withColumn("lead__", F.lit(True))
    frame = Window.partitionBy(*by, "block__").orderBy("step").rowsBetween(-(steps - 1), 0)
    return own.unionByName(lead).withColumn("trailing", F.avg(value).over(frame)).where("not lead__").drop("block__", "lead__")


def diverged(rows: DataFrame, by: list[str], order: str, value: str, limit: float, warm_up: int, steps: int = 20) -> DataFrame:
    """The first step after the warm-up at which the trailing mean is above the limit."""
    over = trailing_mean(rows, by, order, value, steps).where((F.col("step") > warm_up) & (F.col("trailing") > limit))
    return over.groupBy(*by).agg(F.min("step").alias("stopped_at"))
