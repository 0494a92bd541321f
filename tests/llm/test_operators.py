import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexstrata.llm import (
    decontaminate, html_text, language_model, mixing, near_dedup, quality_rules, substring_dedup, suffix_dedup, url_filter, warc,
)
from lexstrata.llm.components import connected_components
from lexstrata.llm.storage import shared_dir

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tid string, blob string, words string"
LABELS = "doc_id long, quality int, toxic int"
RNG = random.Random(7)
VOCABULARY = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "Su", "é") for b in ("ka", "no", "pel", "rit", "ß", "vos", "ún")]


def words(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [words(rng.randint(1, 160), rng) for _ in range(40)]
    passage = words(60, rng)
    texts = base + [base[3], base[3], base[7] + " tail", passage + " " + base[9], base[5] + "\n" + passage, base[11].replace(" ", "\t", 5)]
    edited = words(200, rng).split()
    for k in range(4):
        copy = list(edited)
        copy[50 * k] = "changed"
        texts.append(" ".join(copy))
    texts += [None, "", " \n\t ", "one", "one two", "z " * 400, "ab" * 300, words(4000, rng), "é" * 150, "x\x0by\x1cz"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "t", "b", "w") for i, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_substring_matches_brute_force(docs, corpus):
    got = rows_of(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(corpus))
    assert sum(r[2] for r in got) > 300


@pytest.mark.parametrize("window", [5, 80])
def test_substring_levels(docs, corpus, window):
    got = rows_of(substring_dedup.substring_dedup(docs, window=window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(corpus, window))
    assert substring_dedup.levels(80) == [5, 10, 20, 40, 80] and substring_dedup.levels(35) == [5, 9, 18, 35]


def test_cut_repeats_keeps_columns(docs, corpus):
    out = substring_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    gone = {d: n for d, _, n, _ in brute.substring(corpus)}
    for r in out.collect():
        before = dict(corpus)[r.doc_id]
        assert (r.text == before) == (gone[r.doc_id] == 0)
        if gone[r.doc_id]:
            assert r.n_chars == len(r.text) and len(r.text.split()) == len(brute.WORD.findall(before)) - gone[r.doc_id]


def test_suffix_matches_brute_force(docs, corpus):
    got = rows_of(suffix_dedup.suffix_dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix(corpus))


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in [*range(30), 100, 301]:
        for k in (1, 2, 250):
            text = rng.integers(1, k + 1, n)
            assert suffix_dedup.suffix_order(text).tolist() == sorted(range(n), key=lambda i: tuple(text[i:]))


@pytest.mark.parametrize(("part", "bands", "rows"), [(2, 36, 6), (1024, 36, 6), (3, 24, 1)])
def test_near_duplicates_match_brute_force(docs, corpus, monkeypatch, part, bands, rows):
    """Bands of one coordinate put unlike texts into one bucket, so that whole buckets are verified too."""
    monkeypatch.setattr(near_dedup, "STAR", 3)
    got = rows_of(near_dedup.near_duplicates(docs, part=part, bands=bands, rows=rows), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.components(corpus))
    assert sum(not r[3] for r in got) >= 6


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**62, 400, dtype=np.uint64)
    value = np.concatenate([np.sort(a[:300]), np.sort(a[100:])])
    sig = near_dedup.signatures(value, np.array([0, 300, 600]), 512)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 0.5) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 90), (90, 95), (7, 7)]
    got = rows_of(connected_components(spark.createDataFrame(edges, "a long, b long"), shared_dir(spark), "c"), "node", "root")
    assert got == [(i, 0) for i in range(21)] + [(90, 90), (95, 90), (100, 90)]


def test_quality_base_rules(docs, corpus, spark):
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(0, 40, 2)] + [(None, 1, 0), (3, None, None)], LABELS)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(got) == len(corpus)
    for doc, text in corpus:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_rules(text)
        assert not (r.kept and r.base_failed)


def test_quality_ratio_matches_brute_force(docs, corpus, spark):
    good = {0, 2, 4, 9}
    labels = spark.createDataFrame([(i, 1, 0) for i in good], LABELS)
    n = 1 << 6
    hashed = {}
    pairs = {(a, b) for _, t in corpus for w in [brute.WORD.findall(t or "")] for a, b in zip(w, w[1:])}
    singles = {x for _, t in corpus for x in brute.WORD.findall(t or "")}
    frame = spark.createDataFrame(sorted(pairs), "a string, b string").select("a", "b", F.xxhash64("a", "b").bitwiseAND(F.lit(n - 1)))
    hashed |= {(a, b): h for a, b, h in frame.collect()}
    hashed |= {a: h for a, h in spark.createDataFrame([(x,) for x in sorted(singles)], "a string").select("a", F.xxhash64("a").bitwiseAND(F.lit(n - 1))).collect()}
    features = {d: [hashed[x] for x in w] + [hashed[p] for p in zip(w, w[1:])] for d, t in corpus for w in [brute.WORD.findall(t or "")]}
    raw, own = [0] * n, [0] * n
    for d, f in features.items():
        for h in f:
            raw[h] += 1
            own[h] += d in good
    share = sum(own) / sum(raw)
    p = quality_rules.PRIOR
    weight = [round((math.log(o + p * share) - math.log(share) - math.log(r + p)) * 1e6) / 1e6 for o, r in zip(own, raw)]
    for r in quality_rules.quality_rules(docs, labels, buckets=n, threshold=0.01).collect():
        f = features[r.doc_id]
        want = sum(weight[h] for h in f) / len(f) if f else None
        assert (want is None and r.llr is None) or abs(want - r.llr) < 2e-6
        assert r.kept == (not r.base_failed and want is not None and r.llr >= 0.01)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trained = labels.where("doc_id % 2 = 0")
    got = quality_rules.quality_rules(docs, trained).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.95


def test_mixing_reaches_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    targets = {"plain": 0.6, "toxic": 0.12, "low": 0.2, "low_toxic": 0.08}
    got = mixing.mix(docs, labels, targets=targets, steps=60)
    total = got.agg(F.sum("n_words")).first()[0]
    for d, w in targets.items():
        assert abs(got.agg(F.sum(F.col("n_words") * F.col("rate") * F.col(f"p_{d}"))).first()[0] / total - w) < 0.01
    assert got.agg(F.min("rate")).first()[0] >= 0 and got.count() == docs.count()
    seen = got.join(labels, "doc_id").where("quality = 0").agg(F.avg(F.col("p_low") + F.col("p_low_toxic"))).first()[0]
    assert seen > 0.7


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(11)
    items = [words(rng.randint(8, 40), rng) for _ in range(12)]
    texts = [words(80, rng) for _ in range(20)]
    for k in range(12):
        t = list(items[k])
        for _ in range(k // 2):
            t[rng.randrange(len(t))] = "q"
        texts.append(words(20, rng) + " " + "".join(t).replace("m", "M") + "  " + words(9, rng))
    texts += [None, "", items[0][:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "short"), (None, items[1])], "item_id long, text string")
    got = {r.doc_id: list(zip(r.item_ids, r.distances)) for r in decontaminate.decontaminate(docs, bench).collect()}
    normal = [decontaminate.normalise(x) for x in items]
    for d, t in enumerate(texts):
        want = []
        for i, item in enumerate(normal):
            e = brute.edit_distance(item, decontaminate.normalise(t)) if len(item) >= decontaminate.MIN_CHARS else 99
            if e <= len(item) // decontaminate.CHARS_PER_EDIT:
                want.append((i, e))
        assert got[d] == want, d
    assert sum(map(bool, got.values())) >= 6


def test_decontamination_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(1, words(90)), (1, None), (2, "x")], "doc_id long, text string")
    text = docs.where("text IS NOT NULL AND text <> 'x'").first().text
    bench = spark.createDataFrame([(i, text[40 * i : 40 * i + 120]) for i in range(5)], "item_id long, text string")
    one = rows_of(decontaminate.decontaminate(docs, bench), "doc_id", "item_ids", "n_hits")
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 150)
    assert rows_of(decontaminate.decontaminate(docs, bench), "doc_id", "item_ids", "n_hits") == one
    assert max(r[2] for r in one) == 5


def test_warc_round_trip(spark):
    big, other = "é<p>" * 400, "b" * 1000
    rows = [(1, "http://x/1", big), (5, None, big), (3, "http://x/ü x", big), (2, "u", None), (4, "u", "small"), (6, "u", "small"), (7, "u", other), (8, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None),
    }
    assert got[3].payload_bytes == len(big.encode())
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in warc.rebuild_records(spark, path).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        payload = b"" if got[r.page_id].record_type == "revisit" else (dict((a, c) for a, _, c in rows)[r.page_id] or "").encode()
        assert body == payload + b"\r\n\r\n" and f"Content-Length: {len(payload)}".encode() in head


def test_url_filter(spark):
    t = lambda s: f"timestamp'{s}'"
    entries = spark.sql(
        f"SELECT * FROM VALUES ('a.com','block',{t('2024-01-10')}), ('a.com','remove',{t('2024-03-01')}), ('b.a.com','allow',{t('2024-02-01')}), "
        f"(NULL,'block',{t('2024-01-01')}), ('c.com','block',NULL) AS e(domain, action, listed_at)"
    )
    captures = spark.sql(
        f"SELECT * FROM VALUES (1,'http://www.a.com/x',{t('2024-01-09')}), (2,'http://www.a.com/x',{t('2024-01-10')}), (3,'HTTP://B.A.com:80/',{t('2024-02-15')}), "
        f"(4,'http://b.a.com',{t('2024-01-20')}), (5,'http://a.com',{t('2024-03-01')}), (6,NULL,{t('2024-02-01')}), (7,'http://a.com',NULL), (8,'http://xa.com',{t('2024-02-01')}) "
        "AS c(page_id, url, fetched_at)"
    )
    got = {r.page_id: (r.blocked, r.rule, r.n_active) for r in url_filter.filter_urls(captures, entries).collect()}
    assert got == {1: (False, None, 0), 2: (True, "a.com", 1), 3: (False, "b.a.com", 2), 4: (True, "a.com", 1), 5: (False, None, 0), 6: (False, None, 0), 7: (False, None, 0), 8: (False, None, 0)}


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], LABELS)
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = shared_dir(spark)
    warc.write_archive(pages, path)
    for df in (
        substring_dedup.substring_dedup(empty), suffix_dedup.suffix_dedup(empty), near_dedup.near_duplicates(empty), quality_rules.quality_rules(empty, none),
        mixing.mix(empty, none), decontaminate.decontaminate(empty, bench), language_model.classify(empty, none), html_text.extract(pages), warc.read_archive(spark, path),
    ):
        assert df.count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = words(120)
    docs = spark.createDataFrame([(None, text), (None, text), (4, text), (4, text), (2, words(70)), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1)], LABELS)
    bench = spark.createDataFrame([(1, text[:200])], "item_id long, text string")
    for df in (
        substring_dedup.substring_dedup(docs), suffix_dedup.suffix_dedup(docs), near_dedup.near_duplicates(docs), quality_rules.quality_rules(docs, labels),
        mixing.mix(docs, labels), decontaminate.decontaminate(docs, bench), language_model.classify(docs.withColumn("lang", F.lit(None).cast("string")), labels),
    ):
        assert df.count() == 6
    assert decontaminate.decontaminate(docs, bench).where("contaminated").count() == 4


def test_suffixes_settle_without_a_sort_of_all(monkeypatch):
    """Of equal windows the first stays, whatever the order of strings; only strings are sorted by document, not all suffixes."""
    import numpy as np

    from lexstrata.llm import repeats

    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, 60).astype(np.uint8)) for _ in range(40)]
    window, tids = 4, rng.permutation(40)
    n = np.array([len(t) - window + 1 for t in texts], dtype=np.int32)
    blob = repeats.pack(tids.astype(np.int64), (tids // 2).astype(np.int64), np.zeros(40, np.int32), n, np.frombuffer(b"".join(texts), dtype=np.uint8))
    longest, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, *a, **b: longest.append(len(keys[-1])) or real(keys, *a, **b))
    places = repeats.gathered(pa_table(suffix_dedup._settle_suffixes(window)([blob])))
    monkeypatch.undo()
    got = {(int(t), i) for t, a, k in zip(*places) for i in range(a, a + k)}
    seen, want = set(), set()
    for t in np.argsort(tids):
        for i in range(n[t]):
            w = texts[t][i : i + window]
            want |= {(int(tids[t]), i)} if w in seen else set()
            seen.add(w)
    assert got == want
    assert max(longest) <= 40


def pa_table(found):
    import pyarrow as pa

    from lexstrata.llm import repeats

    return pa.Table.from_batches([repeats._batch(list(found))])
