import numpy as np

from lumenq.llm import packing


def test_pack_keeps_capacity_and_every_item():
    draw = np.random.default_rng(1)
    for capacity in (1, 7, 100, 512):
        sizes = draw.integers(1, capacity + 1, 300)
        bins = packing.pack(sizes, capacity)
        assert (bins >= 0).all() and np.bincount(bins, weights=sizes).max() <= capacity


def test_two_items_for_the_smallest():
    # Greedy alone fills 10 with 6 + 3; giving up the 3 for 2 + 2 leaves nothing unused.
    bins = packing.pack(np.array([6, 3, 2, 2]), 10)
    assert bins[0] == bins[2] == bins[3] != bins[1]
    assert len(packing.pack(np.zeros(0, np.int64), 10)) == 0


def test_containers(spark):
    counts = spark.createDataFrame([(1, 25, "x"), (2, 4, "x"), (3, 6, "x"), (4, 0, "x"), (5, None, "x"), (6, 10, "x")], "doc_id long, n_tokens long, lot string")
    kinds = spark.createDataFrame([("k", 10), ("bad", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    rows = packing.containers(counts, kinds).collect()
    used = {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert sorted((r.doc_id, r.part, r.n_tokens) for r in rows) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 4), (3, 0, 6), (6, 0, 10)]
    assert max(used.values()) == 10 and len(used) == 5


def test_texts(spark):
    documents = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "x" * 100_000), (5, "<|endoftext|>")], "doc_id long, text string")
    counted = {r.doc_id: r.n_tokens for r in packing.token_counts(documents).collect()}
    assert counted.keys() == {1, 4, 5} and counted[1] == 3 and counted[5] > 1
    kinds = spark.createDataFrame([("k", 16)], "container_kind string, capacity_tokens int")
    assert packing.fill(packing.packed(documents, kinds), kinds).first().tokens == sum(counted.values())
    assert packing.packed(documents.limit(0), kinds).count() == 0
