from lexstrata import storage


def test_clean_deletes_intermediates_but_kept_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "_made", {})
    monkeypatch.setattr(storage, "_kept", {})
    source = tmp_path / "source"
    spark.range(3).write.parquet(str(source))
    table = storage.kept(spark, "table", str(source), lambda: spark.read.parquet(str(source)))
    parts = [storage.materialize(spark.range(n), "part") for n in (4, 5)]
    never = storage.shared_dir(spark)
    paths = [p.inputFiles()[0].rpartition("/")[0] for p in parts]
    assert [p.count() for p in parts] == [4, 5] and all(storage.exists(spark, p) for p in paths) and not storage.exists(spark, never)
    assert storage.clean(spark) == 2 and not any(storage.exists(spark, p) for p in paths)
    assert table.count() == 3 and storage.kept(spark, "table", str(source), lambda: 1 / 0).count() == 3
    assert storage.clean(spark) == 0
