import random
import re
from collections import Counter

import pytest

from lexstrata.llm import collocations

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, longest=3, least=10, absorbed=50, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    gone = set()
    for (lang, *w), n in held.items():
        for k in range(2, len(w)):
            gone.update(p for i in range(len(w) - k + 1) if 100 * n >= absorbed * held[p := (lang, *w[i : i + k])])
    out = {}
    for (lang, *w), a in held.items():
        if (lang, *w) in gone:
            continue
        cuts = [(1_000_000 * a * a // (counts[(lang, *w[:k])] * counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [*"aabbbcd", "Été", "x\x1cy", "É", "N.B", "e-mail", "10,5"]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", " ", "  ", "\t", ". ", " \n", "! ")) for _ in range(n))
    out = [(rng.choice(("en", "de", None, "und", "")), text(rng.randrange(1, 90))) for _ in range(300)]
    same = ("en", "Alpha beta GAMMA delta alpha beta gamma")
    return out + [same] * 9 + [("en", None), (None, ""), ("de", " \t.\n"), ("fr", "one two"), ("en", "a a a a a a a a a a a a")] + [("xx", "z " * 40_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(i % 9 or None, lang, text, "n", 5, "p", 7) for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, lang string, text string, phrase string, size int, part string, n long")


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("parts", (1, 5))
def test_brute_force(docs, rows, parts):
    want = brute(rows)
    assert got(collocations.collocations(docs.repartition(parts))) == want and len(want) > 100


def test_parameters(docs, rows, monkeypatch):
    """Longer phrases, other thresholds and shares, few of each language, small runs and a narrow sketch."""
    monkeypatch.setattr(collocations, "BUSY", 2)
    assert got(collocations.collocations(docs, 4, 5, 80, 7)) == brute(rows, 4, 5, 80, 7)
    assert got(collocations.collocations(docs, 2, 1, 50, 40)) == brute(rows, 2, 1, 50, 40)


def test_runs_of_texts(rows, monkeypatch):
    """Kernels: sketches of many small runs, merged, lose no phrase that reaches the threshold, and counts are exact."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "RUN", 50)
    monkeypatch.setattr(collocations, "HELD", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array(["und" if x is None else x for x, _ in rows])], ["text", "lang"])
    full = [bytearray(8192) for _ in collocations.ODD]
    for b in collocations._merge(10)(collocations._sketch(3, 10, 16)(iter([batch]))):
        for r in b.to_pylist():
            full[r["row"]][r["block"] * 8192 : (r["block"] + 1) * 8192] = r["often"]

    class Shared:
        value = [bytes(f) for f in full]

    counts = Counter()
    for b in collocations._exact(3, 16, Shared)(iter([batch])):
        for r in b.to_pylist():
            counts[r["lang"], r["phrase"]] += r["count"]
    want = Counter()
    for lang, *rest in brute(rows, absorbed=101):
        want[lang, rest[1]] = rest[2]
    assert want and all(counts[k] == n for k, n in want.items())


def test_great_counts(spark):
    """Products past 64 bits are exact."""
    phrases = spark.createDataFrame([("en", "a b", 2, 3_000_000_001), ("en", "a", 1, 4_000_000_007), ("en", "b", 1, 3_000_000_011)], "lang string, phrase string, size int, count long")
    r = collocations.with_scores(phrases.where("size = 2"), phrases).first()
    assert r.score == 1_000_000 * 3_000_000_001**2 // (4_000_000_007 * 3_000_000_011) and (r.a, r.l, r.r) == (3_000_000_001, 4_000_000_007, 3_000_000_011)


def test_ranks_in_parts(spark):
    scored = spark.range(5000).selectExpr("'en' AS lang", "concat('p', id) AS phrase", "id % 7 AS a", "1L AS l", "1L AS r", "id % 11 AS score")
    spark.conf.set("spark.sql.shuffle.partitions", "130")
    try:
        rows = collocations.leading(scored, 300).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(((-(i % 11), -(i % 7), f"p{i}") for i in range(5000)))[:300]
    assert sorted((r["rank"], r.phrase) for r in rows) == [(i, p) for i, (_, _, p) in enumerate(want, 1)]


def test_empty(docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("lang = 'fr'")).count() == 0
    with pytest.raises(ValueError, match="from 1 to 255"):
        collocations.collocations(docs, least=0)
