import inspect

import pytest
from pyspark.sql import functions as F

from lumenq.functions import text
from lumenq.operators import fit, routing, stats, training
from lumenq.plans import data_queries, io_queries, metric_queries, traffic_queries


def test_collate_pads_to_the_longest_row_and_cuts_nothing(spark):
    rows = spark.createDataFrame([(0, [1] * 100), (1, [2] * 70), (8, [3])], "id long, ids array<int>")
    wide = training.batch_width(rows, "ids", F.floor(F.col("id") / 8))
    padded, mask, last = training.collate(F.col("ids"), F.col("width"))
    got = {r.id: r for r in wide.select("id", padded.alias("ids"), mask.alias("mask"), last.alias("last")).collect()}
    assert got[0].ids == [1] * 100 and got[0].mask == [1] * 100 and got[0].last == 99
    assert got[1].ids == [2] * 70 + [0] * 30 and got[1].mask == [1] * 70 + [0] * 30 and got[1].last == 69
    assert got[8].ids == [3] and got[8].last == 0
    with pytest.raises(Exception, match="longer than its batch"):
        rows.select(training.collate(F.col("ids"), F.lit(99))[0]).collect()


def test_recent_window_is_that_of_the_server(spark, tmp_path):
    asks = [(k, "ask", f"r{k}") for k in range(700)]
    rows = spark.createDataFrame([*asks, (700, "outcome", "r0"), (701, "outcome", "r699"), (702, "outcome", "other")], "log_pos long, kind string, id string")
    rows.write.parquet(str(tmp_path / "traffic_log.parquet"))
    sf = str(tmp_path)
    assert routing.RECENT == 100_000
    assert {r.log_pos for r in io_queries.jon9(spark, sf).collect()} == {700, 701}
    assert data_queries.str5(spark, sf).count() == 700 and io_queries.top7(spark, sf).count() == 700
    assert {r.log_pos for r in io_queries.jon9(spark, sf, 2).collect()} == {701}
    assert {r.log_pos for r in data_queries.str5(spark, sf, 2).collect()} == {698, 699}
    assert {r.id for r in io_queries.top7(spark, sf, 2).collect()} == {"r698", "r699"}


def test_stream_of_hours_keeps_the_last_day(spark, tmp_path):
    times = ["2024-01-01 00:10:00", "2024-01-01 00:50:00", "2024-01-03 10:00:00", "2024-01-04 09:59:00", "2024-01-04 10:00:00"]
    rows = spark.createDataFrame([(k, t, "a" if k < 4 else None) for k, t in enumerate(times)], "event_id long, ts string, event_type string")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.event_type: r.closed for r in io_queries.str2_hours(spark, str(tmp_path)).collect()} == {"a": 4, None: 1}


def test_prefix_and_continuation_over_whole_prompts(spark, tmp_path):
    state = "one two three four five six seven"
    spark.createDataFrame([(1, " F ", state)], "example_id long, family string, state string").write.parquet(str(tmp_path / "examples.parquet"))
    question = [("f", "n", "choice", "Which one?", [("card limit", None, None), ("refund", "money back", None)])]
    spark.createDataFrame(question, "family string, qname string, qtype string, instructions string, criteria array<struct<opt:string,descr:string,val:double>>").write.parquet(str(tmp_path / "questions.parquet"))
    prefix = spark.range(1).select(F.size(text.words(text.prefix(F.lit(state)))).alias("n")).first().n
    assert [(r.example_id, r.shared) for r in traffic_queries.tok2(spark, str(tmp_path)).collect()] == [(1, prefix)]
    rest = traffic_queries.tok3(spark, str(tmp_path)).orderBy("k").collect()
    assert [r.rest for r in rest] == [" card limit", " refund"] and all(r.context_tokens > prefix for r in rest)
    seam = spark.createDataFrame([(["a", "b", "\n"], [["a", "b", "\n\n", "x"], ["a", "b", "\n", "y"]])], "w array<string>, whole array<array<string>>")
    assert seam.select(text.shared_prefix_length(F.col("w"), F.col("whole")).alias("n")).first().n == 2


def test_differing_labels(spark):
    own = spark.createDataFrame([("A", [1]), ("B", [2, 3]), ("C", [4])], "letter string, ids array<int>")
    other = spark.createDataFrame([("A", [1]), ("B", [2]), ("D", [4])], own.schema)
    assert sorted(r.letter for r in text.differing_labels(own, other).collect()) == ["B", "C"]


def test_csv_keeps_carriage_returns_and_backslashes(spark, tmp_path):
    texts = ["a\rb", "a\r\nb", "back\\slash", 'end\\"', "\r", " plain \r"]
    rows = spark.createDataFrame([(k, "t", x, "l") for k, x in enumerate(texts)], "sample_id long, task string, state string, label string")
    rows.write.parquet(str(tmp_path / "samples.parquet"))
    got = {r.sample_id: r.chars for r in io_queries.src1(spark, str(tmp_path)).collect()}
    assert got == {k: len(x) for k, x in enumerate(texts)}


def test_wire_serialises_every_task(spark):
    sf = "/root/testdata/sf0.001"
    assert io_queries.snk6(spark, sf).count() == io_queries.facts(spark, sf).count()


@pytest.mark.parametrize(("query", "module", "operator", "argument", "count"), [("fit7", fit, "temperature_interval", "resamples", 200), ("fit12", fit, "ece_floor", "draws", 200), ("fit11", stats, "pooled", "policy", 2000), ("agg18", stats, "intervals", "policy", 2000)])
def test_registered_resamples_are_the_defaults(spark, monkeypatch, query, module, operator, argument, count):
    real, used = getattr(module, operator), []

    def spy(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        used.append(bound.arguments[argument])
        raise LookupError

    monkeypatch.setattr(module, operator, spy)
    with pytest.raises(LookupError):
        getattr(metric_queries, query)(spark, "/root/testdata/sf0.001")
    assert [getattr(x, "resamples", x) for x in used] == [count]
