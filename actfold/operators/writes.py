"""Write semantics over Parquet: upserts, whole replacements of a parent's rows, publishing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actfold import workers


def upserted(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "ingest_seq") -> DataFrame:
    """old and new with one row a key, the last ingested. Keys with a null are all kept, since null equals nothing."""
    rows = old.unionByName(new)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_n", F.when(whole, place).otherwise(1)).where("_n = 1").drop("_n")


def replaced(old: DataFrame, new: DataFrame, keys: list[str], refreshed: DataFrame | None = None) -> DataFrame:
    """old without any row of a refreshed key, and new: a parent's rows go and come together.

    ``refreshed`` names the keys, also those that have no new row; by default
    those of new.
    """
    gone = (refreshed if refreshed is not None else new).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def replaced_children(old: dict[str, DataFrame], new: dict[str, DataFrame], parents: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """Every child table with the refreshed parents' rows replaced."""
    return {name: replaced(old[name], new[name], keys, parents) for name in old}


def changes(segments: DataFrame, keys: list[str], most: int = 600) -> DataFrame:
    """The changed segments as rows of the change table, their texts to 600 characters."""
    return segments.where("kind != 'plain'").select(*keys, F.col("seg_ix").alias("seq"), "kind", "line", "page", F.substring("text", 1, most).alias("text"))


def write_partitions(df: DataFrame, path: str, by: str = "session") -> None:
    """Overwrites only the partitions that df has. df must not read the same path."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def rewrite(spark: SparkSession, path: str, make, by: str = "session") -> None:
    """Replaces a table by what ``make`` says of it: written beside it first, so nothing is read while it is overwritten."""
    fresh = f"{path}.next"
    make(spark.read.parquet(path)).write.mode("overwrite").parquet(fresh)
    write_partitions(spark.read.parquet(fresh), path, by)


def write_if_any(df: DataFrame, path: str) -> bool:
    """JSON, or nothing at all where there are no rows."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").json(path)
    return True


def file_each(rows: DataFrame, path: str, name: str, content: str, suffix: str = "") -> DataFrame:
    """Makes a file of each row below a folder; gives (folder, files), a row a task that has any, when it is evaluated.

    A file's name has its task, the row's name and its place in the task, so rows
    of one name are files of their own. Each attempt of a task has a folder of
    its own; those that count are those of the rows given back, which Spark
    commits as a whole, so lost attempts leave stray files at worst. Files are
    made through pyarrow's file systems: Spark's writers make files by thousands
    only with a folder and several calls for each.
    """
    workers.reach(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, n = TaskContext.get().partitionId(), f"{path}/{uuid.uuid4().hex}", 0
        fs, root = pafs.FileSystem.from_uri(at if ":" in at else f"file://{at}")
        for batch in batches:
            for label, value in zip(batch.column(0), batch.column(1), strict=True):
                if not n:
                    fs.create_dir(root)
                with fs.open_output_stream(f"{root}/part-{task:05d}-{n:08d}-{quote(label.as_py() or '', safe='=')}{suffix}", compression=None, buffer_size=0) as out:
                    out.write(value.as_buffer())
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n], pa.int64())], names=["folder", "files"])

    return rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "folder string, files long")


def enumeration(listed: DataFrame) -> DataFrame:
    """The index of bills (session, num, ...) of listing pages, first row of a number kept, with totals and a mismatch flag."""
    w = Window.partitionBy("session", "num").orderBy("page", "row_ix")
    rows = listed.where("num is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    totals = listed.groupBy("session").agg(F.max("total").alias("reported"), F.countDistinct("num").alias("scraped"))
    return rows.drop("total").join(totals, "session").withColumn("mismatch", F.col("reported") != F.col("scraped"))


def bill_pages(track: DataFrame, bills: DataFrame, refs: DataFrame, stats: DataFrame, areas: DataFrame, sponsors: DataFrame, claims: DataFrame) -> DataFrame:
    """One wide row a bill with all that its page shows."""
    keys = ["session", "num"]
    r = refs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bill_section", "statute", "action", "words_added", "words_deleted"))).alias("refs"))
    c = claims.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "quote", "statute"))).alias("claims"))
    out = bills.join(track.drop("label", "chapter_law").hint("merge"), keys, "left")
    for part in (r, stats, areas.drop("title"), sponsors, c):
        out = out.join(part.hint("merge"), keys, "left")
    return out
