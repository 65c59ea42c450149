"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from actfold import workers


#: Stands for null in keys made of text.
NULL_KEY = "\x00none"
#: Rows of a batch that goes to Python.
ROWS_AT_ONCE = 1_000


def short_batches(spark: SparkSession) -> None:
    """Texts may be long, so batches to Python are kept to fewer rows than Spark's default (a session setting)."""
    workers.reach(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_AT_ONCE:
        spark.conf.set(key, str(ROWS_AT_ONCE))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named by place, and the new name of each old one (of equal names, the first's).

    Under these names neither case variants nor doubled names are ambiguous, and
    nothing that an operator adds can clash; ``toDF(*df.columns)`` restores them.
    """
    at: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, f"_c{i}")
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), at


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Exactly the named columns, as new_name="old_name".

    Columns are found by exact name and place, so further columns may have any
    name. Spark still prunes what is not picked.
    """
    own, at = numbered(df)
    for name in cols.values():
        if name not in at:
            raise ValueError(f"no column {name!r} in {df.columns}")
    return own.select(*[F.col(at[old]).alias(new) for new, old in cols.items()])


def with_columns(df: DataFrame, read: str | tuple[str, ...], start: Callable[[], Callable[..., list[list]]], added: str) -> DataFrame:
    """df with columns (``added``, as DDL) that Python makes of the columns to read, batch by batch.

    ``start`` is called once a task and returns what maps a list of values for
    each column read to a list of values for each added column. All other
    columns pass as they are, by place; those named like an added one are
    replaced.
    """
    short_batches(df.sparkSession)
    new = T._parse_datatype_string(added)
    drop = {f.name.lower() for f in new}
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in drop]
    names = [df.columns[i] for i in keep]
    rows = numbered(df)[0].select(*[f"_c{i}" for i in keep])
    at, kinds = [names.index(c) for c in ((read,) if isinstance(read, str) else read)], list(to_arrow_schema(new).types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            columns = make(*[batch.column(k).to_pylist() for k in at])
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new.names])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *new.fields])).toDF(*names, *new.names)


_KEPT: dict = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps for its next task: one operator's at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def text_chunks(texts: list, most: int = 1_000_000) -> Iterator[list]:
    """Runs of texts of about ``most`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t or "")
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def gathered(batches: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[tuple[list, list]]:
    """Ids and texts of several batches, until they have about ``most`` characters, so that words are looked up together."""
    ids, texts, n = [], [], 0
    for batch in batches:
        ids += batch.column(0).to_pylist()
        more = batch.column(1).to_pylist()
        texts += more
        n += sum(len(t) for t in more if t)
        if n >= most:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names; a temporary one only where none is set (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


class Scratch:
    """Tables written to the shared checkpoint folder, to cut lineage.

    A lost executor costs nothing that is already written: later stages read
    the files again. ``drop`` removes a table that no result needs any more.
    """

    def __init__(self, spark: SparkSession):
        workers.reach(spark)
        self.spark, self.root, self.n = spark, f"{checkpoint_root(spark)}/actfold-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """node, component (smallest reachable node) for every node of edges(a, b: long).

    Alternating large-star and small-star rounds over the edge table: each
    round is a grouped minimum (combined before the shuffle, so a hub node
    sends one row a task) and a join back. The minima are written first: read
    again, both sides of the join are shuffled for it alone, and adaptive
    execution can split a hub's rows.
    Nothing is collected but a row count and a checksum a round.
    """
    now = work.save(edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    seen = None
    while True:
        n, check = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if (n, check) == seen or not n:
            break
        seen = (n, check)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        large = work.save(large, "large")
        work.drop(least)
        least = work.save(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least.hint("merge"), "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").union(least.select("hi", F.col("m").alias("lo"))).distinct()
        small = work.save(small, "small")
        work.drop(least)
        work.drop(now)
        work.drop(large)
        now = small
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of the key, so the same ones on every run."""
    workers.reach(df.sparkSession)
    n = df.count()
    if n <= rows:
        return df
    slots = 1 << 20
    return df.where(F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(17)), F.lit(slots)) < max(1, int(slots * rows / n)))
