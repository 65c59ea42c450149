"""Files written by queries and read as files: one for each record, wherever it was written."""

from pathlib import Path

from pyspark.sql import functions as F

from actfold.plans import published


def test_an_index_file_is_one_record_in_one_folder(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") > 5, "1-URGENT").alias("o_orderpriority")).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(published, "folder", lambda spark, name: str(tmp_path / name))
    rows = published.index_files(spark, str(tmp_path)).collect()
    assert {(r.session, r.reported_total, r.num, r.label, r.title) for r in rows} == {("2024", 400 if k < 800 else 200, k, f"HB {k}", "1-URGENT" if k > 5 else None) for k in range(1000)} and len(rows) == 1000
    files = list(Path(tmp_path / "index").rglob("*.json"))
    assert len(files) == 3 and {f.parent for f in files} == {tmp_path / "index"}


def test_pages_that_share_an_id_are_files_of_their_own(spark, tmp_path, monkeypatch):
    """Every row is a file, and rows of one file of the table are written by many tasks."""
    rows = [(k % 60, f"<p>{k}</p>" if k % 7 else None) for k in range(90)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(published, "folder", lambda spark, name: str(tmp_path / name))
    got = published.page_files(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.nbytes) for r in got) == sorted((k, len(h or "") + 1) for k, h in rows)
    tasks = {f.name.split("-")[1] for f in (tmp_path / "files").rglob("part-*.txt")}
    assert len(tasks) > 8


def test_files_of_lost_attempts_are_not_read(spark, tmp_path, monkeypatch):
    """Files lie in a folder a task, not one each; a stray folder beside them, as a lost attempt leaves it, isn't read. Null ids and empty tables are no error."""
    spark.createDataFrame([(k if k else None, f"é{k}") for k in range(300)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "page_id long, html string").write.parquet(str(tmp_path / "none" / "pages.parquet"))
    monkeypatch.setattr(published, "folder", lambda spark, name: str(tmp_path / name))
    (tmp_path / "files" / "stray").mkdir(parents=True)
    (tmp_path / "files" / "stray" / "part-00000-00000000-page_id=999.txt").write_text("lost")
    rows = published.page_files(spark, str(tmp_path)).collect()
    assert sorted(str(r.page_id) for r in rows) == sorted(str(k) if k else "None" for k in range(300)) and {r.nbytes for r in rows} == {4, 5, 6}
    folders = {f.parent for f in (tmp_path / "files").rglob("part-*.txt")}
    assert 8 < len(folders) <= published.FILE_TASKS + 1
    assert published.page_files(spark, str(tmp_path / "none")).count() == 0
