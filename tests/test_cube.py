import pytest
from pyspark.sql import functions as F

from lexstrata.operators import cube, score, views
from lexstrata.plans import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ("id", "topic", "subtopic", "band", "p_ai", "ci_low", "ci_high", *score.SIGNALS)


@pytest.fixture(scope="module")
def stored(spark):
    return queries._cube(spark, SF)


def rows_of(df):
    return sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("scope", ({}, {"dataset_id": 1, "topic": "india"}, {"topic": "General"}))
def test_view_equals_rescoring(spark, stored, scope):
    """Merged cells and histograms give what calibrating the scope's own rows gives."""
    sets = queries.datasets(spark)
    got = cube.view(*stored, sets, **scope)
    shown = views.view(queries._analysed(spark, SF), sets, **scope).withColumn("scope", F.lit(0))
    want = rows_of(score.era_scores(shown, "scope", keep_stored=True))
    assert rows_of(got) == want and want


def test_ids_and_bare_scopes(spark, stored):
    """An id view has its own rows' baseline; without earlier-dated vectors stored scores stay; empty views are empty."""
    rows, cells = stored
    sets = queries.datasets(spark)
    some = rows.where("id % 3 = 1").select("id")
    shown = views.view(queries._analysed(spark, SF), sets, ids=some).withColumn("scope", F.lit(0))
    assert rows_of(cube.view(rows, cells, sets, ids=some)) == rows_of(score.era_scores(shown, "scope", keep_stored=True))
    late = rows.where("year >= 2019").select("id")
    bare = cube.view(rows, cells, sets, ids=late)
    want = {r.id: r.p_ai for r in rows.join(late, "id").collect()}
    assert {r.id: r.p_ai for r in bare.collect()} == {i: p for i, p in want.items() if i in {r.id for r in bare.collect()}} and bare.count()
    assert cube.view(rows, cells, sets, dataset_id=99).count() == 0
    assert cube.view(rows, cells, sets, ids=some.limit(0)).count() == 0


def test_stored_summary(spark, stored):
    """A summary of stored scores from cells equals that of the rows, for every scope and either metric."""
    rows, cells = stored
    sets = queries.datasets(spark)
    for metric in ("documents", "words"):
        for scope in ({}, {"dataset_id": 2}, {"topic": "germany"}, {"dataset_id": 99}):
            part, shown = cube.scope(cells, sets, **scope), cube.scope(rows, sets, **scope)
            got, want = cube.stored_summary(part, metric), views.summary(score.forced_human(shown), metric)
            got, want = got.first().asDict(), want.first().asDict()
            assert {k: round(v, 6) if isinstance(v, float) else v for k, v in got.items()} == {k: round(v, 6) if isinstance(v, float) else v for k, v in want.items()}


def test_cells_add_up(spark, stored):
    """Null topics, sources and years, documents without vectors and repeated rows all count once each."""
    rows, cells = stored
    assert cells.agg(F.sum("documents")).first()[0] == rows.count()
    odd = rows.limit(20).withColumns({"source": F.lit(None).cast("string"), "year": F.lit(None).cast("int"), "embedding": F.when(F.col("id") % 2 == 0, F.col("embedding"))})
    twice = cube.cells(odd.unionByName(odd))
    assert twice.agg(F.sum("documents")).first()[0] == 40 and twice.select("source", "year").distinct().collect() == [("", 0)]
    assert cube.cells(rows.limit(0)).count() == 0
    parts = cube.cells(rows.where("id % 2 = 0")).unionByName(cube.cells(rows.where("id % 2 = 1")))
    whole, merged = cube.baseline(cells), cube.baseline(parts)
    assert merged.centroid == pytest.approx(whole.centroid) and merged.moments == pytest.approx(whole.moments)


def test_ranks_by_histogram(spark):
    values = [5, 5, 5, 1 << 20, 7, 0, (1 << 30) - 1, 7]
    counts = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").agg(F.count("*").alias("k"))
    got = {r.v: r["rank"] for r in cube.rank_of(counts, "v", "k", "rank").collect()}
    ordered = sorted(values)
    want = {v: sum(i for i, x in enumerate(ordered) if x == v) / ordered.count(v) / (len(values) - 1) for v in values}
    assert got == pytest.approx(want)
    assert [r["rank"] for r in cube.rank_of(counts.where("v = 0"), "v", "k", "rank").collect()] == [0.5]


def test_a_view_writes_one_table_and_reads_narrow_ones(spark, stored, monkeypatch):
    written = []
    real = cube.materialize
    monkeypatch.setattr(cube, "materialize", lambda df, name, folder=None: written.append(name) or real(df, name, folder))
    plan = cube.view(*stored, queries.datasets(spark), dataset_id=1)._jdf.queryExecution().executedPlan().toString()
    assert written == ["distances"] and "documents.parquet" not in plan and "ArrowEvalPython" not in plan and "embedding" not in plan
