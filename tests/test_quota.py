import random

import pytest

from lexstrata.sources import ingest

CAPS = {"India": 12, "United States": 9, "Germany": 5, "Australia": 30}
ORDER = list(CAPS)


def plain_loop(rows, caps):
    """(place, row): picks and topics of each row in order; what is stored."""
    left, keys, out = dict(caps), set(), []
    for place, row, picks, key in sorted(rows, key=lambda r: (r[0], r[1])):
        need = [left[p] for p, _ in picks]
        i = max(range(len(need)), key=lambda i: (need[i], -i))
        topic = picks[i][1]
        if need[i] > 0 and topic is not None and left[topic] > 0 and key not in keys:
            left[topic] -= 1
            if key is not None:
                keys.add(key)
            out.append((place, row, picks[i][0]))
    return sorted(out)


def news(rng, n, scarce):
    rows = []
    for i in range(n):
        names = [c for c in ORDER if rng.random() < (0.02 if c == scarce else 0.45)] or ["India"]
        picks = [(c, rng.choice((c, c, c, rng.choice(ORDER), None))) for c in names]
        rows.append((f"http://a/{rng.randrange(n)}", i, picks, rng.choice((None, f"k{rng.randrange(n // 2)}", f"k{rng.randrange(n // 2)}"))))
    return rows


@pytest.mark.parametrize("seed, scarce, run", ((1, None, 1000), (2, None, 25), (3, "Australia", 40)))
def test_runs_equal_one_loop(spark, seed, scarce, run):
    """In one run or many, with rows stored under another country than picked, repeated keys, full and scarce countries."""
    rows = news(random.Random(seed), 300, scarce)
    flat = [(place, row, n, pick, topic, key) for place, row, picks, key in rows for n, (pick, topic) in enumerate(picks)]
    choices = spark.createDataFrame(flat, "place string, row long, n int, pick string, topic string, key string").repartition(5)
    got = sorted(tuple(r) for r in ingest.assigned_in_order(choices, CAPS, run).collect())
    want = plain_loop(rows, CAPS)
    assert got == want and len(want) > 25


def test_no_rows(spark):
    none = spark.createDataFrame([], "place string, row long, n int, pick string, topic string, key string")
    assert ingest.assigned_in_order(none, CAPS).count() == 0
    assert ingest.news_documents(spark.createDataFrame([(None,), ("x\ty",), ("",)], "value string")).count() == 0
