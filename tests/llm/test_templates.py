import random

from lumenq.llm import templates

DOCS, ITEMS = "doc_id long, text string, template string, pos string", "item_id long, task string, text string, codes string"


def brute(docs, items, n=10):
    def grams(text):
        w = [x.lower() for x in templates._WORD.findall(text or "")]
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    return {(d[0], i[0]) for d in docs for i in items if grams(d[1]) & grams(i[2])}


def test_against_brute_force(spark, monkeypatch):
    draw = random.Random(2)
    words = ["the", "Anna", "berlin", "7", "90x", "km", "was", "red", "Und", "so"]
    items = [(k, "t", " ".join(draw.choice(words) for _ in range(draw.randrange(1, 40))), "x") for k in range(20)] + [(50, "t", None, "x"), (51, "t", "", "x")]
    docs = []
    for k in range(60):
        w = [draw.choice(words) for _ in range(draw.randrange(0, 60))]
        if k % 2:
            source = draw.choice(items[:20])[2].split()
            at = draw.randrange(len(source))
            w[5:5] = source[at : at + draw.randrange(8, 16)]
        docs.append((k, draw.choice([" ", ", ", "_"]).join(w).upper() if k % 3 == 0 else " ".join(w), "x", "y"))
    docs += [(90, None, "x", "y"), (91, "", "x", "y"), (92, "filler " * 30_000 + (items[0][2] + " ") * 3, "x", "y")]
    documents, held = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for size in (templates.SIEVE, 64):
        monkeypatch.setattr(templates, "SIEVE", size)
        found = templates.leaks(documents, held).where("literal > 0")
        assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, items)


def test_reparameterised(spark):
    item = "Does Anna want 12 apples if Anna sells 5"
    docs = [(1, "Does Berta want 30 apples if Berta sells 7", "x", "y"), (2, "Does Berta want 30 apples if Carla sells 7", "x", "y"), (3, item.lower(), "x", "y")]
    found = {r.doc_id: (r.literal, r.reparameterised) for r in templates.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "t", item, "x")], ITEMS), window=9).collect()}
    assert found == {1: (0, 1), 3: (1, 0)}


def test_precision_and_recall_of_planted_questions(spark):
    """Items with exchanged numbers, names and units are found; look-alikes with another question aren't."""
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(draw.randrange(2, 5))) for _ in range(400)]
    names = ["Anna", "Berta", "Carla", "Dora", "Emil", "Fritz", "Gustav", "Hanna"]
    units = ["km", "kg", "hours", "days", "euros"]

    def question():
        return [draw.choice(["<name>", "<number>", "<unit>"]) if draw.random() < 0.2 else draw.choice(vocabulary) for _ in range(24)]

    def fill(slots):
        chosen = {}
        out = []
        for k, w in enumerate(slots):
            key = (w, k) if w == "<number>" else w
            if w.startswith("<") and key not in chosen:
                chosen[key] = {"<name>": draw.choice(names), "<number>": str(draw.randrange(10_000)), "<unit>": draw.choice(units)}[w]
            out.append(chosen.get(key, w))
        return " ".join(out)

    asked = [question() for _ in range(60)]
    items = [(k, "t", fill(q), "x") for k, q in enumerate(asked)]
    docs, planted = [], set()
    for k in range(300):
        lead, tail = (" ".join(draw.choice(vocabulary) for _ in range(15)) for _ in range(2))
        q = draw.randrange(60)
        if k % 3 == 0:
            body = fill(asked[q])
            planted.add((k, q))
        elif k % 3 == 1:
            # Every fifth word is another one.
            body = fill([draw.choice(vocabulary) if j % 5 == 2 else w for j, w in enumerate(asked[q])])
        else:
            # A table: placeholders only.
            body = " ".join(f"{draw.choice(names)} {draw.randrange(100)} {draw.choice(units)}" for _ in range(8))
        docs.append((k, f"{lead} {body} {tail}", "x", "y"))
    found = {(r.doc_id, r.item_id) for r in templates.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and len(found & planted) >= 0.9 * len(found)


def test_empty(spark):
    documents, held = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert templates.leaks(documents, held).count() == 0
    assert templates.leaks(spark.createDataFrame([(1, "a b c d e f g h i j k", "x", "y")], DOCS), held).count() == 0
