import json
import random

from lumenq.operators import delivery

SCHEMA = "log_pos long, kind string, id string, ts double, outcomes string, log_id int"


def brute(rows):
    """log_pos of all copies but the first of each chain."""
    groups = {}
    for pos, kind, key, ts, outcomes, _ in rows:
        if key is not None:
            o = None if outcomes is None else json.dumps(json.loads(outcomes), sort_keys=True)
            groups.setdefault((kind, key, o), []).append((ts if ts is not None else float("-inf"), pos))
    out = set()
    for found in groups.values():
        found.sort()
        chain = [found[0]]
        for a, b in zip(found, [*found[1:], (float("inf"), None)], strict=True):
            if b[1] is not None and (b[0] == a[0] or b[0] - a[0] < 0.001):
                chain.append(b)
            else:
                out |= {p for _, p in chain} - {min(p for _, p in chain)}
                chain = [b]
    return out


def test_against_brute_force_with_hot_id_and_window_borders(spark, monkeypatch):
    monkeypatch.setattr(delivery, "CELLS_PER_WINDOW", 4)
    draw = random.Random(3)
    rows = []
    for pos in range(3000):
        key = "hot" if pos % 3 == 0 else draw.choice(["a", "b", "c", None, "", f"x{pos}"])
        outcomes = draw.choice([None, '{"a": 1, "b": true}', '{"b":true,"a":1}', '{"a": null}'])
        rows.append((pos, draw.choice(["ask", "outcome"]), key, draw.choice([None, 100 + draw.randrange(40) * 0.0004]), outcomes, 1))
    draw.shuffle(rows)
    log = spark.createDataFrame(rows, SCHEMA)
    got = {r.log_pos for r in delivery.repeated_deliveries(log).collect()}
    assert got == brute(rows)
    kept = delivery.deliver_once(log)
    assert kept.columns == log.columns
    assert sorted(r.log_pos for r in kept.collect()) == sorted({r[0] for r in rows} - got)


def test_stored_and_new(spark):
    stored = spark.createDataFrame([(1, "ask", "a", 1.0, None, 0)], SCHEMA)
    new = spark.createDataFrame([(5, "ask", "a", 1.0, None, 0), (6, "ask", "b", 1.0, "not json", 0)], SCHEMA)
    assert sorted(r.log_pos for r in delivery.deliver_once(new, stored).collect()) == [1, 6]


def test_empty(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert delivery.deliver_once(log).count() == 0
    assert delivery.repeated_deliveries(log).count() == 0
