import random

import numpy as np

from lumenq.llm import fmindex, spans

SCHEMA = "doc_id long, text string, pid string, begin int"


def brute(docs, least):
    where = {}
    for key, text, *_ in docs:
        for k in range(len(text or "") - least + 1):
            where.setdefault(text[k : k + least], []).append((key, k))
    pairs, covered = set(), {}
    for found in where.values():
        ids = sorted({d for d, _ in found})
        pairs |= {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}
        if len(ids) > 1:
            for d, k in found:
                covered.setdefault(d, set()).update(range(k, k + least))
    return pairs, {d: len(c) for d, c in covered.items()}


def corpus(seed):
    draw = random.Random(seed)
    text = lambda n, letters="abcdeé𝒳": "".join(draw.choice(letters) for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 35, 90)] + ["ab" * 30, "z" * 50]
    docs = []
    for k in range(80):
        parts = [text(draw.randrange(0, 60))]
        for _ in range(draw.randrange(3)):
            s = draw.choice(shared)
            at = draw.randrange(max(1, len(s) - 20))
            parts += [s[at : at + draw.randrange(15, 90)], text(draw.randrange(30))]
        docs.append((k, "".join(parts), "x", 1))
    # A house phrase longer than an anchor in every third text, but shorter than a run.
    phrase = text(16)
    docs += [(100 + k, text(25) + phrase + text(25), "x", 1) for k in range(40)]
    docs += [(200 + k, "the very same text of some length", "x", 1) for k in range(5)]
    return [*docs, (300, None, "x", 1), (301, "", "x", 1), (302, text(30_000, "abcdefgh") + shared[4], "x", 1)]


def test_pairs_and_coverage_against_brute_force(spark):
    # With 10 some anchors are hot, and with 2 their trimmed pieces are crowded too.
    for seed, hot in ((1, 1000), (2, 10), (3, 2)):
        docs = corpus(seed)
        documents = spark.createDataFrame(docs, SCHEMA)
        pairs, covered = brute(docs, 20)
        assert {(r.doc_a, r.doc_b) for r in spans.pairs(documents, 20, shard_chars=2000, hot_rows=hot).collect()} == pairs
        assert {r.doc_id: r.shared_chars for r in spans.coverage(documents, 20, shard_chars=2000, hot_rows=hot).collect()} == covered


def test_segments_grow_with_texts_not_with_pairs(spark):
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    passage = text(220)
    for m in (50, 400):
        found = fmindex.shared_segments([text(90) + passage + text(90) for _ in range(m)], np.ones(m), 200)
        assert m <= len(found) <= 12 * m
    # The same passage around hot anchors: the text beside it is trimmed, equal windows are indexed once.
    documents = spark.createDataFrame([(k, text(90) + passage + text(90)) for k in range(400)], "doc_id long, text string")
    members, segments = spans.shared_pieces(documents, 200, hot_rows=50)
    assert segments.count() < 3 * 400 and members.count() < 60 * 400 and members.join(segments, "pid").select("doc_id").distinct().count() == 400
    assert spans.pairs(documents, 200, hot_rows=50).count() == 400 * 399 // 2


def test_segments_against_brute_force():
    for seed in range(12):
        draw = random.Random(seed)
        base = ["".join(draw.choice("ab" if seed % 3 == 0 else "abcdefg") for _ in range(draw.choice([60, 200]))) for _ in range(4)]
        texts = []
        for _ in range(30):
            t = "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(40)))
            for _ in range(draw.randrange(3)):
                s = draw.choice(base)
                a = draw.randrange(len(s) - 10)
                t += s[a : a + draw.randrange(10, 90)] + "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(30)))
            texts.append(t)
        texts = list(dict.fromkeys(texts))
        copies = np.array([draw.choice([1, 1, 2]) for _ in texts])
        where = {}
        for q, t in enumerate(texts):
            for k in range(len(t) - 19):
                where.setdefault(t[k : k + 20], []).append((q, k))
        classes, of = {}, {}
        for q, c, first, last in fmindex.shared_segments(texts, copies, 20, stride=draw.choice([7, 50, 400]), leap=draw.choice([3, 16, 128])).tolist():
            classes.setdefault(c, set()).add(q)
            of.update({(q, k): c for k in range(first, last + 1)})
        assert set(of) == {x for found in where.values() for x in found if len(found) > 1 or copies[x[0]] > 1}
        assert all(classes[of[x]] == {q for q, _ in found} for found in where.values() for x in found if x in of)


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 64)
    make = spans.Anchors(20)
    text = corpus(4)[-1][1][:3000]
    whole = [a for c, _, at in spans._blocks(np.array([1]), [text], 20) for a in at[make.pick(make.grams(c), np.ones(len(c) - 19, bool))]]
    assert max(np.diff(np.unique(whole))) <= make.window


def test_suffix_array():
    draw = np.random.default_rng(3)
    symbols = draw.integers(1, 3, 200)
    order, _, _ = fmindex.suffix_array(symbols, 200)
    text = symbols.tolist()
    assert [text[k:] for k in order] == sorted(text[k:] for k in range(200))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spans.pairs(empty).count() == 0 and spans.coverage(empty).count() == 0


def test_own_copies_are_not_shared_elsewhere(spark):
    draw = random.Random(2)
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    long_, own = text(400), text(400)
    documents = spark.createDataFrame([(1, long_ + text(80) + long_ + text(90) + own + text(70) + own), (2, text(50) + "2" + long_[:300] + "3" + text(30))], "doc_id long, text string")
    assert {r.doc_id: (r.spans, r.shared_chars) for r in spans.coverage(documents).collect()} == {1: (2, 600), 2: (1, 300)}
