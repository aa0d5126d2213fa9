from lumenq.llm import formats

SCHEMA = "example_id long, family string, state string, copies string"


def test_canonical_state():
    same = ['{"a": "Hello, World", "b": [1, {"c": "X y"}]}', '{ "B" : [1,{"C":"xY!"}], "a":"hello world"}']
    assert formats.canonical_state(same[0]) == formats.canonical_state(same[1])
    assert formats.canonical_state('{"a": [1, 2]}') != formats.canonical_state('{"a": [2, 1]}')
    assert formats.canonical_state('{"a": 1}') != formats.canonical_state('{"a": "1"}')
    assert formats.canonical_state('{"a": 1}') != formats.canonical_state("a1")
    assert formats.canonical_state('{"a": 1.0}') != formats.canonical_state('{"a": 1}')
    assert formats.canonical_state('{"a": ') == formats.canonical_state("A")
    assert formats.canonical_state("Ab, c_d") == formats.canonical_state("abCD ")
    assert formats.canonical_state(" \n") is None and formats.canonical_state(None) is None
    assert formats.canonical_state("[1]") == formats.canonical_state("1")
    assert formats.canonical_state('{"a": ' * 20_000).startswith("t")


def test_records_and_members(spark):
    rows = [(1, "f", "Some text.", "x"), (2, "F\n", "some TEXT", "x"), (3, "f", "Some text.", "x"), (4, None, "some text", "x"), (5, None, "Some text", "x"), (6, "f", None, "x"), (7, "f", "  ", "x"), (8, "g", "some text", "x"), (9, "f", "!?", "x"), (10, "f", "long " * 50_000, "x")]
    examples = spark.createDataFrame(rows, SCHEMA)
    records = {r.keep_id: (r.copies, r.writings) for r in formats.collapse(examples).collect()}
    assert records == {1: (3, 2), 4: (2, 2), 8: (1, 1), 9: (1, 1), 10: (1, 1)}
    got = sorted((r.example_id, r.keep_id) for r in formats.members(examples).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert formats.collapse(empty).count() == 0 and formats.members(empty).count() == 0
