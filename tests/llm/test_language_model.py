import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexstrata.llm import language_model as L
from lexstrata.llm.storage import shared_dir

DOCS = "doc_id long, text string, lang string, key string, gram string"
LABELS = "doc_id long, quality int, toxic int"


def texts_of(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé字 ") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def grams(text):
    padded = L.EDGE * (L.ORDER - 1) + text + L.EDGE
    return [padded[i : i + L.ORDER] for i in range(len(text) + 1)]


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        level = Counter(g for t in texts for g in grams(t))
        self.levels = {L.ORDER: level}
        for k in range(L.ORDER - 1, 0, -1):
            level = Counter(g[1:] for g in level)
            self.levels[k] = level
        self.off, self.total, self.freed = {}, {}, {}
        for k, level in self.levels.items():
            n = [sum(v == i for v in level.values()) for i in (1, 2, 3, 4)]
            if n[0] and n[1]:
                y = n[0] / (n[0] + 2 * n[1])
                d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.9, 0.05), i + 0.95) for i in range(3)]
            else:
                d = [0.5, 0.75, 0.9]
            self.off[k] = d
            total, freed = defaultdict(int), defaultdict(float)
            for g, v in level.items():
                total[g[:-1]] += v
                freed[g[:-1]] += d[min(v, 3) - 1]
            self.total[k], self.freed[k] = total, freed

    def p(self, gram, k=L.ORDER):
        lower = self.p(gram[1:], k - 1) if k > 1 else 1 / (len(self.levels[1]) + 1)
        total = self.total[k].get(gram[:-1])
        if not total:
            return lower
        v = self.levels[k].get(gram, 0)
        own = (v - self.off[k][min(v, 3) - 1]) / total if v else 0
        return own + self.freed[k][gram[:-1]] / total * lower


def test_probabilities_match_plain_kneser_ney(spark):
    trusted, other = texts_of(40, 1), texts_of(25, 2) + ["new symbols ÿ", "", "a" * 5000]
    rows = [(t, 1) for t in trusted] + [(t, 0) for t in other]
    model = L.train(spark.createDataFrame(rows, "text string, train int").repartition(3), shared_dir(spark))
    plain = Plain(trusted)
    got = {r.gram: r.p for r in model.collect()}
    assert set(got) == {g for t in trusted + other for g in grams(t)}
    assert all(abs(got[g] - plain.p(g)) < 1e-12 for g in got)
    some = grams(trusted[3])[-1][:-1]
    alphabet = set(plain.levels[1])
    assert abs(sum(plain.p(some + c) for c in alphabet) + plain.p(some + "?") - 1) < 1e-9


def test_scores_match_plain_sums(spark):
    texts = texts_of(60, 4) + [None, "", "x", "é" * 3000]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "k", "g") for i, t in enumerate(texts)] * 2, DOCS).repartition(5)
    model = L.train(docs.select("text", (F.col("doc_id") < 30).cast("int").alias("train")), shared_dir(spark))
    p = {r.gram: r.p for r in model.collect()}
    want = []
    for doc_id, text, lang, *_ in docs.collect():
        g = grams(text or "")
        want.append((doc_id, lang or "", len(g) - 1, round(-sum(math.log2(p[x]) for x in g) / len(g), 4)))
    got = [(r.doc_id, r.lang or "", r.n_symbols, round(r.log2_perplexity, 4)) for r in L.score(docs, model).collect()]
    assert sorted((*x[:3],) for x in got) == sorted((*x[:3],) for x in want)
    assert all(abs(a[3] - b[3]) < 2e-4 for a, b in zip(sorted(got), sorted(want)))


def test_many_shards_give_the_same_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "k", "g") for i, t in enumerate(texts_of(50, 6))], DOCS).repartition(4)
    model = L.train(docs.select("text", F.lit(1).alias("train")), shared_dir(spark))
    rows = lambda: sorted((r.doc_id, round(r.log2_perplexity, 4)) for r in L.score(docs, model).collect())
    few = rows()
    monkeypatch.setattr(L, "SHARD_ROWS", 20)
    many = rows()
    assert [d for d, _ in few] == [d for d, _ in many] and all(abs(a[1] - b[1]) < 2e-4 for a, b in zip(few, many))


def test_thresholds_are_quantiles_of_held_out_text(spark):
    texts = texts_of(90, 8) + [None, ""]
    docs = spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], "k", "g") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 2), 0) for i in range(90)] + [(None, 1, 1), (5, None, None)], LABELS)
    got = {r.doc_id: r for r in L.classify(docs, labels, quantile=0.8).collect()}
    aside = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("text"), F.lit(L.HELD_OUT)) == 0).collect()}
    held = {lang: sorted(got[i].log2_perplexity for i in aside if i < 90 and i % 3 == k and texts[i]) for k, lang in enumerate(("en", "de"))}
    held[None] = sorted(held["en"] + held["de"])
    for i, r in got.items():
        want = held[r.lang][math.ceil(0.8 * len(held[r.lang])) - 1]
        assert r.threshold == want and r.kept == (bool(texts[i]) and r.log2_perplexity <= want)
    assert not got[90].kept and not got[91].kept
    none = L.classify(docs, labels.where("doc_id < 0")).collect()
    assert all(r.threshold == float("inf") and r.kept == (r.n_symbols > 0) for r in none)


def test_held_out_recall_by_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = L.classify(docs, labels).join(labels, "doc_id").groupBy("lang").agg(
        F.avg(F.when(F.col("quality") == 0, (~F.col("kept")).cast("int"))).alias("caught"), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("kept")
    ).collect()
    assert len(got) == 4 and all(r.caught >= 0.9 and r.kept >= 0.95 for r in got), got


def test_exact_quantiles(spark):
    """The value at rank ceil(q n) of each group, with ties and any partitions; no values give no row."""
    rng = random.Random(2)
    groups = {"a": [round(rng.gauss(5, 2), 9) for _ in range(3000)], "b": [1.5] * 40 + [-2.25, 9.0], "c": [0.125], "{}": [3.0, 3.0, 4.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "group string, value double")
    for q in (0.97, 0.5, 0.0, 1.0):
        want = {g: sorted(vs)[max(1, math.ceil(round(q * len(vs), 6))) - 1] for g, vs in groups.items()}
        for parts in (1, 7):
            assert {r.group: r.value for r in L.exact_quantile(df.repartition(parts), q).collect()} == want
    assert L.exact_quantile(df.limit(0), 0.5).count() == 0
