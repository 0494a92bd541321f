import corpus_pipeline
from lexstrata.llm import decontaminate, mixing
from lexstrata.llm.storage import materialize

from . import brute


def holds_an_item(text, items):
    text = decontaminate.normalise(text)
    return any(brute.least_distance(i, text) <= len(i) // decontaminate.CHARS_PER_EDIT for i in items)


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    numbers = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        old, docs = docs, materialize(stage(spark, docs, sf), f"s{k}", str(tmp_path))
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name == "quality rules":
            assert all(not brute.base_rules(t)[5] for t in after.values()) and after
        elif name == "minhash near-dedup":
            assert set(after) == {d for d, _, _, kept in brute.components(list(before.items()), percent=80, size=5) if kept}
        elif name == "substring dedup":
            left = {d: n - gone for d, n, gone, _ in brute.substring(list(before.items()))}
            assert {d: len(brute.WORD.findall(t)) for d, t in after.items()} == {d: n for d, n in left.items() if n}
        elif name == "benchmark decontamination":
            assert set(after) == {d for d, t in before.items() if not holds_an_item(t, items)}
        elif name == "source mixing":
            rate = {r.doc_id: r.rate for r in mixing.mix(old, labels, targets=corpus_pipeline.MIXTURE).collect()}
            assert {r.doc_id: r.mix_rate for r in docs.collect()} == {d: x for d, x in rate.items() if x > 0}
            clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()} & set(before)
            assert len(clean & set(after)) >= 0.95 * len(clean)
        assert docs.columns[: len(columns)] == columns
        numbers.append(len(after))
    assert docs.columns == [*columns, "mix_rate"]
    assert sorted(r[0] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == sorted(after)
