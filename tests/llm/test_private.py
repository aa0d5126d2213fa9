import random

import pytest

from lumenq.llm import private

SCHEMA = "rec string, rec_id long, state string, kind string, found string"

# Names, streets and numbers of other countries; no labeler's list has them.
FIRST = "Oluwaseun Xiaoming Priyanka Thabo Ngozi Siddharth Yevgenia Tuomas Eilidh Rhiannon Kwabena Itziar Anneliese Bogumil Chidinma Dimitra Faisal Gudrun Haruka Iskander Jacinta Kamala Llewellyn Marisol".split()
LAST = "Adeyemi Wang Chaudhuri Mokoena Okonkwo Banerjee Kuznetsova Virtanen MacGillivray Llewelyn Mensah Etxeberria Hoffmeister Kowalewski Eze Papadimitriou Rahman Sigurjonsdottir Nakamura Abdrakhmanov Fernandes Venkataraman Prydderch Quintanilla".split()
STREETS = ["41 Jacaranda Avenue", "7 Baobab Lane", "Eukalyptusweg 19", "12 rue Cassini", "88 Mulberry Terrace", "Tulpenstraat 5", "Calle Almendro, 33", "230 Sycamore Drive, Apt 4"]
WORDS = "the table window lamp garden quickly report late again under blue carpet seems broken today nobody noticed this morning while queue moved slowly behind counter".split()


def held_out(seed):
    """Texts with what must be found in them, written independently of the labelers."""
    draw = random.Random(seed)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    filler = lambda: " ".join(draw.choice(WORDS) for _ in range(draw.randrange(4, 9))).capitalize() + "."
    texts = []
    for k in range(700):
        first, last = draw.choice(FIRST), draw.choice(LAST)
        name = draw.choice([f"{first} {last}", f"{first} {draw.choice('ABCD')}. {last}", f"{first[0]}. {last}"])
        kind, span, text = draw.choice(
            [
                ("name", name, f"Please ask {name} about it."),
                ("name", name, f"Kind regards, {name}"),
                ("name", name, f"{name} called us twice."),
                ("name", name, f"My name is {name} and I wait."),
                ("email", (m := f"{first}.{last}@{draw.choice(['mail', 'corp'])}-{digits(2)}.{draw.choice(['org', 'net'])}".lower()), f"Write to {m} instead."),
                ("email", (m := f"{last} at posteo dot net".lower()), f"My mail is {m} now."),
                ("phone", (m := f"+{draw.choice(['234', '91', '351'])} {digits(3)} {digits(3)} {digits(4)}"), f"You can call {m} tomorrow."),
                ("phone", (m := f"({digits(3)}) {digits(3)}-{digits(4)}"), f"The mobile is {m}."),
                ("id_number", (m := f"{digits(3)}.{digits(3)}.{digits(3)}-{digits(2)}"), f"CPF {m} was typed wrongly."),
                ("id_number", (m := f"{draw.randrange(100, 660)}{digits(6)}"), f"My SSN {m} is on file."),
                ("id_number", (m := f"{digits(8)}{draw.choice('TRWAGMY')}"), f"The DNI number is {m}."),
                ("address", (m := draw.choice(STREETS)), f"We moved to {m} last year."),
                (None, None, f"Order {digits(9)} and invoice {digits(3)} {digits(3)} {digits(3)} are late."),
                (None, None, f"The {draw.choice(['Blue Window', 'Green Garden', 'Silver Table'])} Report is on line {digits(2)}."),
            ]
        )
        texts.append((k, f"{filler()} {text} {filler()}", kind, span))
    return texts


@pytest.fixture(scope="module")
def found(spark):
    texts = held_out(3)
    frame = spark.createDataFrame([("x", k, t, None, None) for k, t, _, _ in texts], SCHEMA)
    return texts, {(r.rec_id, r.kind, r.span) for r in private.spans(frame).collect()}


def test_recall_and_precision_on_texts_that_no_list_knows(found):
    texts, got = found
    wanted = {(k, kind, span) for k, _, kind, span in texts if kind}
    hit = got & wanted
    by_kind = {kind: (sum(x[1] == kind for x in hit), sum(x[1] == kind for x in wanted)) for kind in private.KINDS}
    assert len(hit) >= 0.9 * len(wanted), by_kind
    assert len(hit) >= 0.9 * len(got), sorted(got - wanted)[:20]


def test_numbers_that_name_nobody(found):
    texts, got = found
    plain = {k for k, _, kind, _ in texts if kind is None}
    assert sum(k in plain for k, _, _ in got) <= 0.1 * len(plain)


def test_spans_and_redaction_agree(spark):
    texts = held_out(4)
    frame = spark.createDataFrame([("x", k, t, "a", "b") for k, t, _, _ in texts] + [("x", 9000, None, "a", "b"), ("x", 9001, "", "a", "b"), ("x", 9002, "word " * 30_000, "a", "b")], SCHEMA)
    spans = {}
    for r in private.spans(frame).collect():
        spans.setdefault(r.rec_id, []).append(r)
    for r in private.redacted(frame).collect():
        text = next((t for k, t, _, _ in texts if k == r.rec_id), {9000: None, 9001: "", 9002: "word " * 30_000}.get(r.rec_id))
        at, parts = 0, []
        for s in sorted(spans.get(r.rec_id, []), key=lambda s: s.b):
            assert s.b >= at and text[s.b : s.e] == s.span
            parts += [text[at : s.b], private.PLACEHOLDERS[s.kind]]
            at = s.e
        assert r.state == (None if text is None else "".join([*parts, text[at:]]))


def test_long_comma_form_and_far_words():
    family = "Featherstonehaugh-Cholmondeley-Wolstenholme-Fotheringay-Auchinleck"
    text = "word " * 100 + f"{family}, Maria was here"
    got = {text[b:e] for k, b, e, _ in private.candidates(private._Text(text, private.common_words(private.VOCABULARY))) if k == "name"}
    assert f"{family}, Maria" in got


def test_estimate_follows_agreeing_labelers():
    chance = private.estimate([("phone", "a:+++.", 80), ("phone", "a:-..-", 100), ("phone", "a:+...", 20)])
    assert chance["phone", "a:+++."] > 0.9 and chance["phone", "a:-..-"] < 0.1


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert private.spans(empty).count() == 0 and private.redacted(empty).count() == 0


def test_words_around_are_whole_and_numbers_seldom_tried(monkeypatch):
    text = private._Text("one two9 " + "far-away " * 3 + "x" * 300 + " café_bar ab12cd éa, end", frozenset())
    words = [m.span() for m in private._ANY.finditer(text.low)]
    for begin in range(len(text.low)):
        for end in range(begin + 1, len(text.low), 37):
            before = [text.low[b:e] for b, e in words if e <= begin][-5:]
            assert text.around(begin, end) == (before, [text.low[b:e] for b, e in words if b >= end][:3])

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def finditer(self, *at):
            self.calls += 1
            return self.pattern.finditer(*at)

        def search(self, *at):
            self.calls += 1
            return self.pattern.search(*at)

    counted = [[(form, Counted(p)) for form, p in patterns] for patterns in (private._PHONES, private._IDS)]
    monkeypatch.setattr(private, "_PHONES", counted[0])
    monkeypatch.setattr(private, "_IDS", counted[1])
    if hasattr(private, "_NUMBERS"):
        monkeypatch.setattr(private, "_NUMBERS", tuple((kind, Counted(p), forms) for (kind, p, _), forms in zip(private._NUMBERS, counted, strict=True)))
    # Runs of digits that are neither: no form is tried by itself.
    assert not [c for c in private.candidates(private._Text("On 2024-05-17 08:15 and 2023.11.02 10 of 3 4 5 6 7 8", frozenset())) if c[0] != "name"]
    assert sum(p.calls for patterns in counted for _, p in patterns) == 0
