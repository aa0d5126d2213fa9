"""Queries of sampling, training rows, retrieval, routing and admission (WIN, GEN, VEC, TOP, STR, SET, JON, PRJ)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.functions import dist, text
from lumenq.operators import retrieval, routing, sampling, traffic, training
from lumenq.operators.ranks import hash_unit_sql
from lumenq.plans import decide
from lumenq.plans.base import CONF, FACTS, QUESTIONS, clean, clean_sql, facts, family_questions
from lumenq.plans.metric_queries import rounded
from lumenq.plans.traffic_queries import _BODY
from lumenq.session import load


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labelled").where(F.col("labelled_id").isNotNull()).groupBy("labelled_id").agg(F.first("source").alias("source"), F.first("state").alias("state"), F.first("label").alias("label"), F.first("soft").alias("soft"))
    return rows.select(F.col("labelled_id").alias("id"), "source", text.cut_text(F.col("state")).alias("state"), clean(F.col("label")).alias("label"), "soft")


LABELLED = rf"""l AS (SELECT DISTINCT labelled_id AS id, source, substr(regexp_replace(state, '^\s+|\s+$', '', 'g'), 1, 1500) AS state, {clean_sql("label")} AS label, soft FROM labelled)"""


def _usable(spark, sf):
    """Labelled rows with a text and a label of their source."""
    src = load(spark, sf, "sources").select(F.col("source_name").alias("sn"), "label_list", "shape")
    rows = _labelled(spark, sf).join(src, F.col("source") == F.col("sn")).drop("sn")
    return rows.where(F.length("state") > 0).where(F.array_contains("label_list", F.col("label")))


USABLE = LABELLED + """, us AS (SELECT l.*, label_list, shape FROM l JOIN sources ON source_name = source WHERE length(state) > 0 AND list_contains(label_list, label))"""


def win1(spark, sf):
    rows = _usable(spark, sf).where(F.col("source") == "desk_routes")
    return sampling.balanced(rows, "label", 3, "id", strict=True, labels=["billing", "technical", "sales"]).select("id", "label")


def win2(spark, sf):
    rows = _usable(spark, sf).withColumn("sl", F.concat_ws("|", "source", "label"))
    return sampling.balanced(rows, "sl", 4, "id").select("id", "source", "label")


def win3(spark, sf):
    rows = load(spark, sf, "samples").where(F.col("label").isNotNull()).select("sample_id", clean(F.col("label")).alias("label"))
    return sampling.alternate(rows, "label", "sample_id").select("sample_id", "half")


def win7(spark, sf):
    got = routing.trailing_mean(load(spark, sf, "events").where(F.col("value").isNotNull()), ["user_id"], "event_id", "value")
    return rounded(got.select("event_id", "trailing"))


def win8(spark, sf):
    rows = load(spark, sf, "embeddings").where(F.col("label").isNotNull())
    return sampling.first_per_class(rows, "label", 5, [F.col("vec_id")]).select("vec_id", F.col("label").cast("long").alias("label"))


def agg22(spark, sf):
    rows = load(spark, sf, "traffic_log").where(F.col("id").isNotNull() & (F.col("kind") == "ask"))
    return sampling.first_rows(rows, ["id"], "log_pos").select("log_pos")


def flt4(spark, sf):
    rows = load(spark, sf, "samples").where(F.col("state").isNotNull())
    return rows.where(F.size(text.words(F.col("state"))) <= 60).select("sample_id")


def flt5(spark, sf):
    samples = load(spark, sf, "samples")
    pool = samples.where(clean(F.col("split")) == "train")
    return sampling.not_used(pool, samples.where((clean(F.col("split")) != "train") & F.col("state").isNotNull()), "state").select("sample_id")


def prj7(spark, sf):
    from lumenq.plans.model import shown_state

    rows = load(spark, sf, "examples").where(F.col("state").isNotNull())
    return rows.select("example_id", F.md5(shown_state(F.col("state"))).alias("shown"))


def prj14(spark, sf):
    rows = load(spark, sf, "events")
    kind = sampling.incident(F.when(F.col("user_id") % 2 == 0, "en").otherwise("de"), F.when(F.col("event_type") == "error", "Incident").otherwise(F.col("event_type")))
    return rows.select("event_id", kind.alias("incident"), sampling.member(F.col("event_type"), ["click", "view"]).alias("kept"), sampling.single_label(F.array("event_type"), F.lit("view")).alias("emotional"))


def prj15(spark, sf):
    rows = load(spark, sf, "labelled").where(F.col("soft").isNotNull()).select("labelled_id", "soft").distinct()
    return rows.select("labelled_id", sampling.toxicity_level(F.col("soft")).alias("toxicity"), sampling.hate_level(F.col("soft") * 4 - 2).alias("hate"), sampling.decile(F.col("soft")).alias("decile"))


def prj16(spark, sf):
    rows = load(spark, sf, "documents").where(F.col("text").isNotNull())
    cut = text.cut_text(F.col("text"))
    return rows.select("doc_id", F.md5(cut).alias("cut"), F.length(cut).cast("long").alias("chars"))


_STARS = {"1 star": "dissatisfied", "2 stars": "dissatisfied", "3 stars": "mixed", "4 stars": "satisfied", "5 stars": "satisfied"}


def prj17(spark, sf):
    rows = _usable(spark, sf).where(F.col("source") == "shop_stars")
    return rows.select("id", sampling.relabel(F.col("label"), _STARS).alias("coarse"))


def prj20(spark, sf):
    """Predictions as a matrix aligned to the source's labels."""
    src = load(spark, sf, "sources").select(clean(F.col("source_name")).alias("sn"), "label_list")
    rows = facts(spark, sf).join(src, F.col("task") == F.col("sn"))
    placed = rows.select("id", F.posexplode(F.transform("label_list", lambda o: F.get("p", (F.array_position("options", clean(o)) - 1).cast("int")))).alias("k", "v"), (F.array_position("label_list", F.col("label")) - 1).cast("long").alias("y"))
    return placed.select("id", "k", F.round("v", 6).alias("v"), "y")


def jon2(spark, sf):
    """A lookup of a handful of rows: AQE sends the small side to the tasks after measuring it."""
    src = load(spark, sf, "sources").select("source_name", "dataset")
    return load(spark, sf, "samples").join(src, F.col("task") == F.col("source_name")).groupBy("dataset").agg(F.count(F.lit(1)).alias("samples"))


def _configs(spark, sf):
    """Mean Brier score of each task under each configuration."""
    return facts(spark, sf).groupBy("task", "config").agg(F.avg(dist.brier(F.col("p"), F.col("y"))).alias("b"), F.count(F.lit(1)).alias("n"))


def jon6(spark, sf):
    """Alignment of a row's distribution and its neighbour's: equal label order, else an error."""
    a = facts(spark, sf).select("id", "task", "options", "y")
    b = a.select((F.col("id") - 1).alias("before"), F.col("task").alias("t2"), F.col("options").alias("o2"), F.col("y").alias("y2"))
    joined = a.join(b, (F.col("id") == F.col("before")) & (F.col("task") == F.col("t2")))
    return joined.select("id", (F.col("options") == F.col("o2")).alias("aligned"), (F.col("y") == F.col("y2")).alias("same_label"))


def jon8(spark, sf):
    """Every configuration against the plain one of its task."""
    every = _configs(spark, sf)
    plain = every.where(F.col("config") == "plain").select(F.col("task").alias("t2"), F.col("b").alias("base"))
    return rounded(every.join(plain, F.col("task") == F.col("t2")).select("task", "config", (F.col("b") - F.col("base")).alias("difference")))


def set1(spark, sf):
    parts = [load(spark, sf, "samples").select(F.col("sample_id").alias("id"), "state"), load(spark, sf, "labelled").select(F.col("labelled_id").alias("id"), "state")]
    return parts[0].unionByName(parts[1]).agg(F.count(F.lit(1)).alias("rows"), F.count("state").alias("with_state"), F.sum("id").alias("id_sum"))


def set2(spark, sf):
    """Labels that a source declares and no row has."""
    src = load(spark, sf, "sources").select(F.col("source_name").alias("sn"), "label_list")
    seen = _labelled(spark, sf).where(F.col("label").isNotNull()).groupBy("source").agg(F.collect_set("label").alias("seen"))
    return src.join(seen, F.col("sn") == F.col("source"), "left").select("sn", F.explode(F.array_except("label_list", F.coalesce("seen", F.array().cast("array<string>")))).alias("label"))


def set3(spark, sf):
    """Question names that several families share, and families whose options repeat."""
    rows = load(spark, sf, "questions").select("qname", "family", (F.size(F.array_distinct("criteria.opt")) < F.size("criteria.opt")).alias("repeats"))
    return rows.groupBy("qname").agg(F.count(F.lit(1)).alias("families"), F.count_if("repeats").alias("repeating")).where(F.col("families") > 1)


def set4(spark, sf):
    """Families that have the same options in another order."""
    rows = load(spark, sf, "questions").select("family", F.array_sort("criteria.opt").alias("o"))
    return rows.groupBy("o").agg(F.count(F.lit(1)).alias("families"), F.min("family").alias("first")).where(F.col("families") > 1).select("families", "first")


_CHOICE, _NOUL = ["What is it about?", "Which one fits?"], ["Is it {x}?", "Does {x} fit?"]


def gen1(spark, sf):
    rows = _usable(spark, sf).where(F.col("shape") == "choice")
    got = training.choice_rows(rows, F.col("label_list"), _CHOICE)
    return got.select("id", "instructions", F.array_join("options", "|").alias("shown"), dist.argmax(F.col("target")).cast("long").alias("place"))


def gen2(spark, sf):
    got = training.noul_rows(_usable(spark, sf).where(F.col("shape") == "choice"), F.col("label_list"), _NOUL)
    return got.select("id", "asked", "instructions", F.get("target", F.lit(0)).alias("yes"))


def gen3(spark, sf):
    got = training.native_noul_rows(_usable(spark, sf).where(F.col("shape") == "noul"), F.col("label_list"), ["Is it so?"], ["Is it not so?"])
    return got.select("id", "instructions", F.get("target", F.lit(0)).alias("yes"))


def gen5(spark, sf):
    got = training.score_rows(_usable(spark, sf).where(F.col("shape") == "score"), F.col("label_list"), ["How much?"], "directional", 1.5)
    return got.select("id", F.array_join("options", "|").alias("shown"), F.posexplode("target").alias("k", "t")).select("id", "shown", "k", F.round("t", 6).alias("t"))


def gen7(spark, sf):
    rows = _usable(spark, sf).where(F.col("source") == "desk_routes")
    labels = F.array(*map(F.lit, ["billing", "technical", "sales", "shipping", "security", "other"]))
    return training.build(rows, labels, _CHOICE, _NOUL).groupBy("type", "is_null").agg(F.count(F.lit(1)).alias("rows"))


def _mixture(spark, sf):
    listed = load(spark, sf, "sources").orderBy("source_name").collect()
    sources = [{"name": r.source_name, "shape": r.shape, "labels": r.label_list, "per_class": r.per_class, "wordings": ["How is it?"], "about": _NOUL, "negated": ["Is it not?"], "collapse": _STARS if r.source_name == "shop_stars" else None} for r in listed]
    return training.mixture(_usable(spark, sf).select("id", "source", "state", "label", "soft"), sources, scale=0.25)


def gen8(spark, sf):
    return _mixture(spark, sf).groupBy("source", "type", "is_null").agg(F.count(F.lit(1)).alias("rows"))


def gen9(spark, sf):
    return training.encode(_mixture(spark, sf)).select("id", "type", "is_null", F.size("input_ids").cast("long").alias("tokens"), F.size("label_ids").cast("long").alias("labels"), "penalised")


def gen10(spark, sf):
    rows = load(spark, sf, "samples").where(F.length("state") > 0).select("sample_id", F.transform(text.words(F.col("state")), lambda w: F.length(w)).alias("ids"))
    rows = training.batch_width(rows, "ids", F.floor(F.col("sample_id") / 8))
    padded, mask, last = training.collate(F.col("ids"), F.col("width"))
    return rows.select("sample_id", F.aggregate(padded, F.lit(0), lambda a, b: a + b).cast("long").alias("id_sum"), F.aggregate(mask, F.lit(0), lambda a, b: a + b).cast("long").alias("used"), last.cast("long").alias("last"))


def _vectors(spark, sf):
    return load(spark, sf, "embeddings").where(F.col("label").isNotNull())


def _options(vectors: DataFrame) -> DataFrame:
    cents = retrieval.centroids(vectors)
    return cents.select(F.col("label").cast("int").alias("idx"), F.col("label").cast("string").alias("option"), "centroid")


def _ranked(spark, sf):
    vectors = _vectors(spark, sf)
    return retrieval.rank(vectors, _options(vectors), "vec_id")


def vec2_best(spark, sf):
    """The three best labels of every vector, over blocks of four options."""
    vectors = load(spark, sf, "embeddings").where(F.col("label").isNotNull())
    got = retrieval.best(vectors, _options(vectors), 3, broadcast_options=4)
    return got.select("vec_id", F.posexplode("best").alias("k", "b")).select("vec_id", "k", F.col("b.idx").alias("place"), F.round("b.score", 6).alias("score"))


def agg19(spark, sf):
    got = retrieval.centroids(_vectors(spark, sf)).select(F.col("label").cast("long").alias("label"), F.posexplode("centroid").alias("k", "v"))
    return got.select("label", "k", F.round("v", 6).alias("v"))


def vec2(spark, sf):
    return _ranked(spark, sf).select("vec_id", F.posexplode("scores").alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("v"))


def vec4(spark, sf):
    got = _ranked(spark, sf).withColumn("p", dist.softmax(F.transform("scores", lambda s: 50.0 * s))).withColumn("label", F.col("label").cast("int"))
    return rounded(got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg((dist.argmax(F.col("p")) == F.col("label")).cast("double")).alias("accuracy"), F.avg(dist.brier(F.col("p"), F.col("label"))).alias("brier")))


def vec5(spark, sf):
    vectors = _vectors(spark, sf)
    weights, bias = retrieval.fit_probe(vectors, 10)
    got = retrieval.probe(vectors, weights, bias)
    return rounded(got.groupBy(F.col("label").cast("long").alias("label")).agg(F.avg((dist.argmax(F.col("p")) == F.col("label")).cast("double")).alias("accuracy")), 3)


def top1(spark, sf):
    got = _ranked(spark, sf).select("vec_id", F.posexplode(retrieval.shortlist(F.col("scores"), 3)).alias("k", "place"))
    return got.select("vec_id", "k", F.col("place").cast("long").alias("place"))


def top3(spark, sf):
    names = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("string"))
    kept = _ranked(spark, sf).withColumn("all", names).withColumn("kept", retrieval.narrow(F.lit("choice"), F.col("all"), F.col("scores"), 8, 4))
    return kept.withColumnRenamed("kept", "short").select("vec_id", F.array_join("short", ",").alias("kept"), F.size(F.filter(dist.expand(F.col("all"), F.col("short"), F.transform("short", lambda _: F.lit(0.25))), lambda x: x == 0)).cast("long").alias("cut"))


def agg15(spark, sf):
    return rounded(retrieval.recall_at(_ranked(spark, sf).withColumn("label", F.col("label").cast("int")), ["label"], "scores", "label", 3))


def top6(spark, sf):
    q = load(spark, sf, "questions").where(F.col("qtype") == "score")
    return q.select("family", F.posexplode(F.transform(F.array_sort(F.transform("criteria", lambda c, i: F.struct((-c["val"]).alias("v"), i.alias("i"), c["opt"].alias("o")))), lambda s: s["o"])).alias("k", "option"))


def str1(spark, sf):
    """Asks and outcomes of each hour of arrival."""
    rows = load(spark, sf, "traffic_log")
    return rows.groupBy(F.unix_micros(F.date_trunc("hour", F.col("received_at").cast("timestamp"))).alias("hour_us"), "kind").agg(F.count(F.lit(1)).alias("rows"))


def str3(spark, sf):
    rows = load(spark, sf, "traffic_log").where((F.col("kind") == "ask") & F.col("caller").isNotNull() & F.col("ts").isNotNull())
    # Times in minutes of the log, so that the limit binds at this request rate.
    got = routing.rate_limit(rows.select("log_pos", "caller", (F.col("ts") / 3600).alias("t")), "caller", "t", "log_pos", 3)
    return got.select("log_pos", "admitted", F.col("retry_after").cast("long").alias("retry_after"))


def str4(spark, sf):
    rows = load(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    got = routing.overloaded(rows, "t", 1.8e9, 8)
    return got.agg(F.count(F.lit(1)).alias("moments"), F.max("in_flight").alias("most"))


def str5(spark, sf, most: int = routing.RECENT):
    rows = load(spark, sf, "traffic_log").where((F.col("kind") == "ask") & F.col("id").isNotNull())
    return routing.recent(rows, "log_pos", most).select("log_pos")


def str6(spark, sf):
    """The prior of each family's question over an empty state, scored once, joined where teacher rows are debiased."""
    ex = load(spark, sf, "examples").select("example_id", F.lower(text.strip(F.col("family"))).alias("family"), "teacher")
    questions = decide.plan(family_questions(spark, sf), 1)
    empty = lambda q: decide.combined(decide.score(q.withColumn("prefix", text.prefix(F.lit(text.NULL_STATE))), _prior_scorer), "prior")
    prior = routing.null_priors(questions, empty).select(F.col("family").alias("pf"), "prior")
    got = ex.join(prior, F.col("family") == F.col("pf")).where(F.size("teacher") == F.size("prior"))
    return got.select("example_id", F.posexplode(dist.debias(F.col("teacher"), F.col("prior"))).alias("k", "v")).select("example_id", "k", F.round("v", 6).alias("v"))


def _prior_scorer(prefix: str, branches: list[str], shown: list[list[str]]) -> list[list[float]]:
    """A double of a model that likes early and long options: a logit from place and length."""
    return [[len(o) / 10 - k / 5 for k, o in enumerate(options)] for options in shown]


def str7(spark, sf):
    rows = load(spark, sf, "traffic_log").where(F.col("caller").isNotNull())
    keys = rows.groupBy("caller").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select(F.col("caller").alias("key"))
    return routing.callers(rows.withColumn("key", F.col("caller")), keys).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"))


def _routed(spark, sf):
    ex = load(spark, sf, "examples").select("example_id", F.lower(text.strip(F.col("family"))).alias("family"), F.from_json("shadow", "head string, version int, probabilities array<double>").alias("s"), "teacher")
    requests = ex.select("example_id", "family", F.coalesce("s.probabilities", "teacher").alias("head_p"))
    q = load(spark, sf, "questions")
    heads = q.where(F.col("qtype") == "choice").select("family", F.concat(F.lit("head:"), "family").alias("head"))
    shadows = q.select("family", F.concat(F.lit("shadow:"), "family").alias("head"))
    return routing.route(requests, heads, shadows, 0.2)


def str8(spark, sf):
    return _routed(spark, sf).select("example_id", "served_by", "shadow")


def jon4(spark, sf):
    return _routed(spark, sf).groupBy("served_by").agg(F.count(F.lit(1)).alias("rows"))


def str10(spark, sf):
    """AGG16, STR10: cached share of the prompt tokens of each caller."""
    rows = load(spark, sf, "traffic_log").where(F.col("kind") == "ask").select("caller", F.coalesce(F.length("state"), F.lit(0)).alias("cached"), (F.coalesce(F.length("state"), F.lit(0)) + F.length("questions")).alias("prompt"))
    return rounded(rows.groupBy("caller").agg(F.coalesce(F.try_divide(F.sum("cached"), F.sum("prompt")), F.lit(0.0)).alias("hit_rate")))


def str11(spark, sf):
    return routing.diverged(load(spark, sf, "events").where(F.col("value").isNotNull()), ["event_type"], "event_id", "value", 20.0, 20).withColumn("stopped_at", F.col("stopped_at").cast("long"))


def udf9(spark, sf):
    """Two scorers side by side over every family's question: the largest difference of a probability, and the verdict."""
    q = family_questions(spark, sf).withColumn("prefix", text.prefix(F.lit(text.NULL_STATE)))
    got = decide.verify(q, _prior_scorer, decide.biased_scorer([0.3, 0.2, 0.1]), 0.1)
    return got.select("family", F.round("apart", 6).alias("apart"), "equal")


def ext_volume(spark, sf):
    """Extension: events in tumbling hours."""
    rows = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


QUERIES = {
    "WIN1_balanced_strict": win1, "WIN2_balanced": win2, "WIN3_alternate": win3, "WIN7_trailing_mean": win7, "WIN8_first_per_class": win8, "AGG22_first_row": agg22,
    "FLT4_token_cap": flt4, "FLT5_pool_minus_split": flt5, "PRJ7_state_body": prj7, "PRJ14_label_mappings": prj14, "PRJ15_levels": prj15, "PRJ16_cut_text": prj16, "PRJ17_relabel": prj17, "PRJ20_matrix": prj20,
    "JON2_lookup": jon2, "JON4_head_lookup": jon4, "JON6_alignment": jon6, "JON8_against_reference": jon8, "SET1_union": set1, "SET2_except": set2, "SET3_duplicates": set3, "SET4_set_equality": set4,
    "GEN1_choice_rows": gen1, "GEN2_noul_rows": gen2, "GEN3_native_noul": gen3, "GEN5_score_rows": gen5, "GEN7_build": gen7, "GEN8_mixture": gen8, "GEN9_encode": gen9, "GEN10_collate": gen10,
    "AGG19_centroids": agg19, "VEC2_rank": vec2, "VEC2_best": vec2_best, "VEC4_centroid_classifier": vec4, "VEC5_probe": vec5, "TOP1_shortlist": top1, "TOP3_narrow": top3, "AGG15_recall": agg15, "TOP6_by_value": top6,
    "STR1_log_volume": str1, "STR3_rate_limit": str3, "STR4_queue_cap": str4, "STR5_recent": str5, "STR6_null_prior": str6, "STR7_callers": str7, "STR8_route": str8, "STR10_hit_rate": str10, "STR11_divergence": str11,
    "UDF9_verify": udf9, "EXT_hourly_volume": ext_volume,
}

_H = hash_unit_sql


def _shuffle(items: str, draw: int) -> str:
    return f"list_transform(list_sort(list_transform({items}, lambda x: {{'u': {_H('0', 'id', str(draw), 'x')}, 'x': x}})), lambda s: s.x)"


_OTHERS = "list_filter(label_list, lambda o: o <> label)"
_CENT = """m AS (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL) GROUP BY label, k),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label), cent AS (SELECT label, list(m / n ORDER BY k) AS c FROM m JOIN n USING (label) GROUP BY label),
sc AS (SELECT vec_id, e.label, list(list_sum(list_transform(list_zip(embedding, c), lambda s: s[1]::DOUBLE * s[2])) ORDER BY cent.label) AS s FROM embeddings e, cent WHERE e.label IS NOT NULL GROUP BY vec_id, e.label)"""
_SOFT50 = "list_transform(list_transform(s, lambda x: exp(50 * (x - list_max(s)))), lambda x: x / list_sum(list_transform(s, lambda h: exp(50 * (h - list_max(s))))))"
_BEST = "list_sort(list_transform(list_sort(list_transform(range(1, len(s) + 1), lambda i: {'s': -s[i], 'i': i - 1}))[1:K], lambda t: t.i))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PRIOR = "list_transform(options, lambda o, i: exp(length(o) / 10 - (i - 1) / 5))"
_ROUTED = rf"""e AS (SELECT example_id, lower({_STRIP.format("family")}) AS family, coalesce(CAST(json_extract(shadow, '$.probabilities') AS DOUBLE[]), teacher) AS p FROM examples),
r AS (SELECT example_id, CASE WHEN qtype = 'choice' AND list_reverse_sort(p)[1] - list_reverse_sort(p)[2] >= 0.2 THEN 'head:' || e.family ELSE 'teacher' END AS served_by, CASE WHEN qtype <> 'choice' THEN 'shadow:' || e.family END AS shadow FROM e LEFT JOIN questions q ON q.family = e.family)"""

SQL = {
    "WIN1_balanced_strict": f"WITH {USABLE} SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H('0', 'id')}, id) AS r FROM us WHERE source = 'desk_routes' AND label IN ('billing', 'technical', 'sales')) WHERE r <= 3",
    "WIN2_balanced": f"WITH {USABLE} SELECT id, source, label FROM (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY {_H('0', 'id')}, id) AS r FROM us) WHERE r <= 4",
    "WIN3_alternate": f"SELECT sample_id, CASE WHEN row_number() OVER (PARTITION BY {clean_sql('label')} ORDER BY sample_id) % 2 = 1 THEN 'train' ELSE 'test' END AS half FROM samples WHERE label IS NOT NULL",
    "WIN7_trailing_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS trailing FROM events WHERE value IS NOT NULL",
    "WIN8_first_per_class": "SELECT vec_id, label::BIGINT AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings WHERE label IS NOT NULL) WHERE r <= 5",
    "AGG22_first_row": "SELECT min(log_pos) AS log_pos FROM traffic_log WHERE id IS NOT NULL AND kind = 'ask' GROUP BY id",
    "FLT4_token_cap": r"SELECT sample_id FROM samples WHERE len(regexp_extract_all(state, '( ?\S+|\s)', 1)) <= 60",
    "FLT5_pool_minus_split": f"SELECT sample_id FROM samples WHERE {clean_sql('split')} = 'train' AND (state IS NULL OR state NOT IN (SELECT state FROM samples WHERE {clean_sql('split')} <> 'train' AND state IS NOT NULL))",
    "PRJ7_state_body": f"SELECT example_id, md5({_BODY}) AS shown FROM examples WHERE state IS NOT NULL",
    "PRJ14_label_mappings": "SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_type IS NOT NULL THEN CASE WHEN event_type = 'error' THEN 'yes' ELSE 'no' END END AS incident, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS kept, CASE WHEN event_type = 'view' THEN 'no' ELSE 'yes' END AS emotional FROM events",
    "PRJ15_levels": "SELECT DISTINCT labelled_id, CASE WHEN soft < 0.1 THEN 'not toxic' WHEN soft < 0.4 THEN 'somewhat toxic' WHEN soft < 0.7 THEN 'toxic' ELSE 'very toxic' END AS toxicity, CASE WHEN soft * 4 - 2 > 0.5 THEN 'hateful' WHEN soft * 4 - 2 < -1 THEN 'not hateful' ELSE 'somewhat hateful' END AS hate, 'decile ' || least(floor(soft * 10), 9)::INT AS decile FROM labelled WHERE soft IS NOT NULL",
    "PRJ16_cut_text": f"SELECT doc_id, md5(c) AS cut, length(c) AS chars FROM (SELECT doc_id, nullif(substr({_STRIP.format('text')}, 1, 1500), '') AS c FROM documents WHERE text IS NOT NULL)",
    "PRJ17_relabel": f"WITH {USABLE} SELECT id, CASE label WHEN '3 stars' THEN 'mixed' WHEN '4 stars' THEN 'satisfied' WHEN '5 stars' THEN 'satisfied' ELSE 'dissatisfied' END AS coarse FROM us WHERE source = 'shop_stars'",
    "PRJ20_matrix": f"WITH {FACTS}, j AS (SELECT id, y, list_position(label_list, label) - 1 AS yy, list_transform(label_list, lambda o: p[list_position(options, {clean_sql('o')})]) AS v FROM f JOIN sources ON {clean_sql('source_name')} = task) SELECT id, CAST(unnest(range(len(v))) AS INT) AS k, round(unnest(v), 6) AS v, yy::BIGINT AS y FROM j",
    "JON2_lookup": "SELECT dataset, count(*) AS samples FROM samples JOIN sources ON task = source_name GROUP BY dataset",
    "JON4_head_lookup": f"WITH {_ROUTED} SELECT served_by, count(*) AS rows FROM r GROUP BY served_by",
    "JON6_alignment": f"WITH {FACTS} SELECT a.id, a.options = b.options AS aligned, a.y = b.y AS same_label FROM f a JOIN f b ON b.id = a.id + 1 AND a.task = b.task",
    "JON8_against_reference": f"WITH {FACTS}, g AS (SELECT task, config, avg(list_sum(list_transform(range(1, n + 1), lambda k: pow(p[k] - CASE WHEN k - 1 = y THEN 1 ELSE 0 END, 2)))) AS b FROM f GROUP BY ALL) SELECT g.task, g.config, round(g.b - x.b, 6) AS difference FROM g JOIN g x ON x.task = g.task AND x.config = 'plain'",
    "SET1_union": "SELECT count(*) AS rows, count(state) AS with_state, sum(id)::BIGINT AS id_sum FROM (SELECT sample_id AS id, state FROM samples UNION ALL SELECT labelled_id, state FROM labelled)",
    "SET2_except": f"WITH {LABELLED} SELECT sn, label FROM (SELECT source_name AS sn, unnest(label_list) AS label FROM sources) s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source = s.sn AND l.label = s.label)",
    "SET3_duplicates": "SELECT qname, count(*) AS families, 0::BIGINT AS repeating FROM questions GROUP BY qname HAVING count(*) > 1",
    "SET4_set_equality": "SELECT count(*) AS families, min(family) AS first FROM questions GROUP BY list_sort(list_transform(criteria, lambda c: c.opt)) HAVING count(*) > 1",
    "GEN1_choice_rows": f"""WITH {USABLE}, k AS (SELECT *, least(3 + floor({_H("0", "id", "0")} * 10), len(label_list))::INT AS k FROM us WHERE shape = 'choice'),
o AS (SELECT *, {_shuffle(f"list_concat([label], ({_shuffle(_OTHERS, 1)})[1:k - 1])", 2)} AS options FROM k)
SELECT id, CASE WHEN {_H("0", "id", "3")} < 0.5 THEN 'What is it about?' ELSE 'Which one fits?' END AS instructions, array_to_string(options, '|') AS shown, (list_position(options, label) - 1)::BIGINT AS place FROM o""",
    "GEN2_noul_rows": f"""WITH {USABLE}, a AS (SELECT id, label, CASE WHEN {_H("0", "id", "4")} < 0.5 THEN label ELSE ({_shuffle(_OTHERS, 5)})[1] END AS asked FROM us WHERE shape = 'choice')
SELECT id, asked, replace(CASE WHEN {_H("0", "id", "6")} < 0.5 THEN 'Is it {{x}}?' ELSE 'Does {{x}} fit?' END, '{{x}}', asked) AS instructions, CASE WHEN asked = label THEN 1.0::DOUBLE ELSE 0.0 END AS yes FROM a""",
    "GEN3_native_noul": f"WITH {USABLE}, a AS (SELECT *, {_H('0', 'id', '7')} < 0.35 AS flip FROM us WHERE shape = 'noul') SELECT id, CASE WHEN flip THEN 'Is it not so?' ELSE 'Is it so?' END AS instructions, CASE WHEN label = label_list[CASE WHEN flip THEN 2 ELSE 1 END] THEN 1.0::DOUBLE ELSE 0.0 END AS yes FROM a",
    "GEN5_score_rows": f"""WITH {USABLE}, a AS (SELECT id, label, label_list, CASE WHEN {_H("0", "id", "9")} < 0.5 THEN list_reverse(label_list) ELSE label_list END AS options FROM us WHERE shape = 'score'),
w AS (SELECT *, list_transform(options, lambda o: exp(-1.5 * abs(list_position(label_list, o) - list_position(label_list, label)))) AS e FROM a)
SELECT id, array_to_string(options, '|') AS shown, CAST(unnest(range(len(e))) AS INT) AS k, round(unnest(list_transform(e, lambda x: x / list_sum(e))), 6) AS t FROM w""",
    "GEN7_build": f"""WITH {USABLE}, a AS (SELECT CASE WHEN {_H("0", "id", "14")} < 0.3 THEN 'noul' ELSE 'choice' END AS type, {_H("0", "id", "13")} < 0.1 AS n FROM us WHERE source = 'desk_routes')
SELECT type, false AS is_null, count(*) AS rows FROM a GROUP BY type UNION ALL SELECT type, true, count(*) FROM a WHERE n GROUP BY type""",
    "GEN8_mixture": f"""WITH {USABLE}, m AS (SELECT id, us.source, us.shape, label, soft, greatest(1, round_even(per_class * 0.25, 0)) AS most FROM us JOIN sources ON source_name = us.source),
b AS (SELECT *, label AS cell FROM m WHERE shape <> 'soft_noul' UNION ALL SELECT *, least(floor(soft * 10), 9)::INT::VARCHAR FROM m WHERE shape = 'soft_noul' AND soft IS NOT NULL
  UNION ALL SELECT *, CASE label WHEN '3 stars' THEN 'mixed' WHEN '4 stars' THEN 'satisfied' WHEN '5 stars' THEN 'satisfied' ELSE 'dissatisfied' END FROM m WHERE source = 'shop_stars'),
r AS (SELECT *, row_number() OVER (PARTITION BY source, cell ORDER BY {_H("0", "id")}, id) AS r FROM b),
t AS (SELECT source, CASE WHEN shape = 'choice' AND {_H("0", "id", "15")} >= 0.3 THEN 'choice' WHEN shape = 'score' THEN 'score' ELSE 'noul' END AS type, {_H("0", "id", "13")} < 0.1 AS n FROM r WHERE r <= most)
SELECT source, type, false AS is_null, count(*) AS rows FROM t GROUP BY ALL UNION ALL SELECT source, type, true, count(*) FROM t WHERE n GROUP BY ALL""",
    "GEN10_collate": r"WITH w AS (SELECT sample_id, list_transform(regexp_extract_all(state, '( ?\S+|\s)', 1), lambda w: length(w)) AS ids FROM samples WHERE length(state) > 0) SELECT sample_id, list_sum(ids)::BIGINT AS id_sum, len(ids) AS used, len(ids) - 1 AS last FROM w",
    "AGG19_centroids": f"WITH {_CENT} SELECT label::BIGINT AS label, CAST(unnest(range(64)) AS INT) AS k, round(unnest(c), 6) AS v FROM cent",
    "VEC2_rank": f"WITH {_CENT} SELECT vec_id, CAST(unnest(range(len(s))) AS INT) AS k, round(unnest(s), 6) AS v FROM sc",
    "VEC2_best": f"WITH {_CENT}, b AS (SELECT vec_id, list_sort(list_transform(range(1, len(s) + 1), lambda i: {{'m': -s[i], 'i': i}}))[1:3] AS b FROM sc) SELECT vec_id, CAST(unnest(range(len(b))) AS INT) AS k, (unnest(b).i - 1)::BIGINT AS place, round(-unnest(b).m, 6) AS score FROM b",
    "VEC4_centroid_classifier": f"WITH {_CENT}, pp AS (SELECT label, {_SOFT50} AS p FROM sc) SELECT label::BIGINT AS label, count(*) AS n, round(avg(CAST(list_position(p, list_max(p)) - 1 = label AS INT)), 6) AS accuracy, round(avg(list_sum(list_transform(range(1, 11), lambda k: pow(p[k] - CASE WHEN k - 1 = label THEN 1 ELSE 0 END, 2)))), 6) AS brier FROM pp GROUP BY label",
    "TOP1_shortlist": f"WITH {_CENT} SELECT vec_id, CAST(unnest(range(3)) AS INT) AS k, unnest({_BEST.replace('K', '3')})::BIGINT AS place FROM sc",
    "TOP3_narrow": f"WITH {_CENT} SELECT vec_id, array_to_string({_BEST.replace('K', '4')}, ',') AS kept, 6::BIGINT AS cut FROM sc",
    "AGG15_recall": f"WITH {_CENT} SELECT label::BIGINT AS label, round(avg(CAST(list_contains({_BEST.replace('K', '3')}, label) AS INT)), 6) AS recall, count(*) AS n FROM sc GROUP BY label",
    "TOP6_by_value": "SELECT family, CAST(unnest(range(len(o))) AS INT) AS k, unnest(o) AS option FROM (SELECT family, list_transform(list_sort(list_transform(criteria, lambda c: {'v': -c.val, 'o': c.opt})), lambda s: s.o) AS o FROM questions WHERE qtype = 'score')",
    "STR1_log_volume": "SELECT epoch_us(date_trunc('hour', received_at)) AS hour_us, kind, count(*) AS rows FROM traffic_log GROUP BY ALL",
    "STR4_queue_cap": """WITH m AS (SELECT t, sum(d) AS d FROM (SELECT epoch_us(ts) AS t, 1 AS d FROM events UNION ALL SELECT epoch_us(ts) + 1800000000, -1 FROM events) GROUP BY t),
r AS (SELECT sum(d) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS f FROM m) SELECT count(*) AS moments, max(f) AS most FROM r WHERE f > 8""",
    "STR5_recent": "SELECT log_pos FROM traffic_log WHERE kind = 'ask' AND id IS NOT NULL ORDER BY log_pos DESC LIMIT 100000",
    "STR6_null_prior": rf"""WITH {QUESTIONS}, e AS (SELECT example_id, lower({_STRIP.format("family")}) AS family, teacher FROM examples), pr AS (SELECT family, {_PRIOR} AS prior FROM q),
d AS (SELECT example_id, list_transform(list_zip(teacher, list_transform(prior, lambda x: x / list_sum(prior))), lambda s: s[1] / greatest(s[2], 1e-12)) AS v FROM e JOIN pr USING (family) WHERE len(teacher) = len(prior))
SELECT example_id, CAST(unnest(range(len(v))) AS INT) AS k, round(unnest(list_transform(v, lambda x: x / list_sum(v))), 6) AS v FROM d""",
    "STR7_callers": "SELECT kind, count(*) AS rows FROM traffic_log WHERE caller IN (SELECT caller FROM traffic_log WHERE caller IS NOT NULL GROUP BY caller HAVING count(*) >= 20) GROUP BY kind",
    "STR8_route": f"WITH {_ROUTED} SELECT example_id, served_by, shadow FROM r",
    "STR10_hit_rate": "SELECT caller, round(coalesce(sum(coalesce(length(state), 0)) / nullif(sum(coalesce(length(state), 0) + length(questions)), 0), 0), 6) AS hit_rate FROM traffic_log WHERE kind = 'ask' GROUP BY caller",
    "STR11_divergence": """WITH t AS (SELECT event_type, avg(value) OVER w AS m, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_type, min(step) AS stopped_at FROM t WHERE step > 20 AND m > 20 GROUP BY event_type""",
    "UDF9_verify": f"""WITH {QUESTIONS}, b AS (SELECT family, {_PRIOR} AS x, list_transform(options, lambda o, i: exp(greatest(0.4 - i / 10, 0))) AS y FROM q),
d AS (SELECT family, list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] / list_sum(x) - y[i] / list_sum(y)))) AS apart FROM b)
SELECT family, round(apart, 6) AS apart, apart <= 0.1 AS equal FROM d""",
    "EXT_hourly_volume": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
}
