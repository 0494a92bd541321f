import pytest
from pyspark.sql import functions as F

from lexstrata.fixtures import corpus
from lexstrata.functions.text import document_date, year_of_date
from lexstrata.operators import score
from lexstrata.plans import queries
from lexstrata.storage import shared_dir
from lexstrata.streaming import calibration

SF = "/root/testdata/sf0.001"
COLUMNS = ("id", "dataset_id", *score.SIGNALS, "p_ai", "ci_low", "ci_high", "band")


@pytest.fixture(scope="module")
def docs(spark):
    """Collection 1 has a baseline from the first batch on, 2 gets one in the last, 3 has none at all."""
    rows = corpus(spark, SF).withColumn("year", year_of_date(document_date()))
    rows = rows.where("dataset_id < 3 OR year NOT BETWEEN 1 AND 2018").withColumn("k", F.when(F.col("year").between(1, 2018), F.when(F.col("dataset_id") == 1, 0).otherwise(2)).otherwise(F.col("id") % 3))
    return rows.drop("year").cache()


def rows_of(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def want(docs):
    return rows_of(score.era_scores(score.featured(docs.drop("k"))))


@pytest.fixture(scope="module")
def store(spark, docs):
    path = shared_dir(spark)
    for k in range(3):
        calibration.process(docs.where(F.col("k") == k).drop("k"), k, path)
    return path


def test_batches_equal_one_calibration(spark, store, want):
    assert rows_of(calibration.scores(spark, store)) == want


def test_only_what_moved_is_scored_anew(spark, store, docs):
    done = {(r.batch, r.dataset_id): (r.rescored, r.rows) for r in calibration.history(spark, store).collect()}
    n = {(r.k, r.dataset_id): r["count"] for r in docs.groupBy("k", "dataset_id").count().collect()}
    upto = lambda k, d: sum(v for (b, s), v in n.items() if b <= k and s == d)
    assert [done[k, 1] for k in range(3)] == [(True, n[0, 1]), (False, n[1, 1]), (False, n[2, 1])]
    assert done[2, 2] == (True, upto(2, 2)) and done[1, 3] == (True, upto(1, 3))


def test_a_batch_that_runs_again(spark, docs, want):
    """Parts of a batch that failed don't count until it ran again; ids that came before are left out."""
    path = shared_dir(spark)
    calibration.process(docs.where("k = 0").drop("k"), 0, path)
    before = rows_of(calibration.scores(spark, path))
    score.featured(docs.where("k = 1").drop("k")).drop("text").write.parquet(calibration._part(path, "features", 1))
    assert calibration.committed(spark, path) == 0 and rows_of(calibration.scores(spark, path)) == before
    for _ in range(2):
        calibration.process(docs.where("k < 2").drop("k").unionByName(docs.where("k = 1").drop("k")), 1, path)
    calibration.process(docs.drop("k"), 2, path)
    assert rows_of(calibration.scores(spark, path)) == want


def test_a_file_stream(spark, docs, want, tmp_path):
    for k in range(2):
        docs.where(f"k % 2 = {k}").drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.drop("k").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = calibration.calibrate_stream(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert query.exception() is None and calibration.committed(spark, str(tmp_path / "store")) == 1
    assert rows_of(calibration.scores(spark, str(tmp_path / "store"))) == want


def test_an_empty_batch(spark, docs):
    path = shared_dir(spark)
    calibration.process(docs.limit(0).drop("k"), 0, path)
    assert calibration.committed(spark, path) == 0 and calibration.scores(spark, path).count() == 0


def test_no_batch_in_one_file(spark, tmp_path, monkeypatch):
    """Each of the three batches is written and read in as many parts as the documents have, with the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(4, "doc_id").write.parquet(f"{tmp_path}/sf/documents.parquet")
    monkeypatch.setattr(queries, "shared_dir", lambda spark: f"{tmp_path}/run")
    columns = ["id", "band"]
    got = sorted(map(tuple, queries.stream_scores(spark, f"{tmp_path}/sf").select(*columns).collect()))
    assert got == sorted(map(tuple, queries.era_scores(spark, SF).select(*columns).collect()))
    assert len(list((tmp_path / "run" / "arriving").glob("part-*"))) == 12
    assert spark.read.parquet(f"{tmp_path}/run/store/commits").count() == 3
