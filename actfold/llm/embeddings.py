"""Embedding near-duplicates: ITQ codes, multi-index Hamming tables, reranking with the original vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import Scratch, components, pick, sampled, with_columns


def as_vector(values: list | None) -> np.ndarray | None:
    """The components as float64; None if there are none, or one is null or not finite."""
    if not values or None in values:
        return None
    v = np.array(values, dtype=np.float64)
    return v if np.isfinite(v).all() else None


def leaders(unit: np.ndarray, least: float, block: int = 512) -> np.ndarray:
    """Unit vectors of which none is within ``least`` of an earlier one, so no group of near copies decides what is learned."""
    kept = np.empty((0, unit.shape[1]))
    for a in range(0, len(unit), block):
        some = unit[a : a + block]
        some = some[~(some @ kept.T >= least).any(axis=1)] if len(kept) else some
        near = np.tril(some @ some.T >= least, -1)
        kept = np.concatenate((kept, some[~near.any(axis=1)]))
    return kept


class Codes:
    """Iterative quantisation: a rotation of the principal axes whose signs lose least, cut at medians so that bits are balanced.

    It is learned from a sample without near copies. The mean and the medians
    are drawn to the origin by as many vectors there as there are bits, so a
    sample of few decides little. ``origin``: cuts pass through the origin.
    """

    def __init__(self, sample: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 11, least: float = 0.93, origin: bool = False):
        self.dim, self.bits = sample.shape[1], bits
        unit = leaders(sample / np.linalg.norm(sample, axis=1, keepdims=True), least)
        sure = 0.0 if origin else len(unit) / (len(unit) + bits)
        self.mean = sure * unit.mean(axis=0)
        flat = unit - unit.mean(axis=0)
        axes = np.linalg.eigh(flat.T @ flat)[1][:, ::-1]
        found: list[np.ndarray] = []
        while (have := sum(x.shape[1] for x in found)) < bits:  # more bits than dimensions: further rotations, from other starts
            some = axes[:, : bits - have]
            view = flat @ some
            turn = np.linalg.qr(np.random.default_rng(seed + have).standard_normal((some.shape[1], some.shape[1])))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(view @ turn >= 0, 1.0, -1.0).T @ view)
                turn = (u @ v).T
            found.append(some @ turn)
        self.axes = np.concatenate(found, axis=1)
        self.cut = sure * np.median((unit - self.mean) @ self.axes, axis=0)

    def code(self, vectors: list[np.ndarray]) -> np.ndarray:
        """The bits of each vector."""
        out = np.zeros((len(vectors), self.dim))
        for k, v in enumerate(vectors):  # other dimensions are cut or filled up, which keeps equal ones comparable
            n = min(self.dim, len(v))
            out[k, :n] = v[:n] / np.linalg.norm(v)
        return (out - self.mean) @ self.axes >= self.cut


def substrings(bits: np.ndarray, each: int, tables: int) -> np.ndarray:
    """One integer for each code and table, of ``each`` bits."""
    return np.stack([bits[:, t * each : (t + 1) * each].astype(np.int64) @ (1 << np.arange(each)) for t in range(tables)], axis=1)


def sample_of(rows: DataFrame, sample_rows: int) -> np.ndarray | None:
    """About ``sample_rows`` usable vectors, those of the commonest dimension."""
    got = [v for r in sampled(rows, "vec_id", sample_rows).select("vector").collect() if (v := as_vector(r[0])) is not None and v.any()]
    if not got:
        return None
    dims = np.bincount([len(v) for v in got])
    most = int(dims.argmax())
    return np.stack([v for v in got if len(v) == most])


def turned(sample: np.ndarray, least: float, seed: int = 5) -> np.ndarray:
    """For each sample vector another unit one at cosine ``least``, turned in a random direction."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    side = np.random.default_rng(seed).standard_normal(unit.shape)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    size = np.linalg.norm(side, axis=1, keepdims=True)
    return least * unit + math.sqrt(1 - least * least) * side / np.where(size > 0, size, 1)


def fit_codes(sample: np.ndarray, each: int, tables: int, least: float, miss: float = 0.03, most: int = 64) -> tuple[Codes, int, int]:
    """Codes, the tables they need, ``tables`` at least, and how many bits may differ: pairs at cosine ``least`` made of sample vectors share no substring in a share ``miss`` at most.

    layout() takes angles about the origin. Codes are cut about the mean, and
    where vectors share a direction that widens the angle of a pair, so the
    misses of the fitted codes decide (within two standard errors). Tables are
    added, by half of what there are, until they are few enough; beyond
    ``most`` tables the cuts pass through the origin, at the price of fuller
    buckets. Codes have 128 bits at least, of which those behind the tables
    only tell apart what a bucket holds: pairs at cosine ``least`` differ in
    more bits than are allowed with chance one in millions.
    """
    first, some = tables, sample[np.random.default_rng(7).permutation(len(sample))[:2000]]
    near, origin = turned(some, least), False
    while True:
        codes = Codes(sample, 64 * max(2, -(-each * tables // 64)), least=least, origin=origin)
        x, y = codes.code(list(some)), codes.code(list(near))
        off = (x != y).sum(axis=1)
        allowed = min(codes.bits, math.ceil(off.mean() + 6 * max(off.std(), math.sqrt(codes.bits) / 4)))
        alike = (substrings(x, each, tables) == substrings(y, each, tables)).any(axis=1)
        if origin or sample.shape[1] < 2 or (~alike).mean() <= miss + 2 * math.sqrt(miss * (1 - miss) / len(some)):
            return codes, tables, allowed
        if tables >= most:
            tables, origin = first, True
        else:
            tables = min(most, tables + (tables + 1) // 2)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the first columns; rows come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        if not batch.num_rows:
            continue
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def layout(rows: int, least: float, miss: float = 0.03, at_once: int = 256) -> tuple[int, int]:
    """(bits of a substring, tables) for labels of up to ``rows`` vectors.

    Substrings grow with the logarithm of the rows, from 8 bits on, so buckets
    stay near ``at_once`` rows. A bit of a pair at cosine ``least`` agrees with
    chance 1 - angle / pi; tables are added until such a pair shares no
    substring with chance ``miss`` only, whatever the substrings' length.
    """
    each = max(8, math.ceil(math.log2(max(1, rows) / at_once)))
    shared = (1 - math.acos(least) / math.pi) ** each
    return each, math.ceil(math.log(miss) / math.log(1 - shared))


#: Hot buckets are broadcast only up to this many.
MOST_BROADCAST = 50_000


class _Group:
    """What the rows of one pair of blocks of a bucket have, and which pairs of them count there."""

    def __init__(self, run: pa.Table, each: int):
        column = lambda c: run.column(c).to_numpy()
        self.ids, self.n, self.own, self.label = column("vec_id"), column("n"), column("own"), column("lab")
        self.two, self.t = int(run.column("i")[0].as_py()) != int(run.column("j")[0].as_py()), int(run.column("t")[0].as_py())
        raw = np.frombuffer(b"".join(run.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.code = np.ascontiguousarray(raw).view(np.uint64)
        self.parts = substrings(np.unpackbits(raw, axis=1), each, self.t) if self.t else np.empty((len(self.ids), 0))

    def counted(self, near: np.ndarray, first: int) -> np.ndarray:
        """``near`` (rows from ``first`` on x all) without pairs of two labels or of one block where two meet, and those that an earlier table holds."""
        rows = slice(first, first + len(near))
        near &= self.label[rows, None] == self.label
        if self.two:
            near &= self.own[rows, None] != self.own
        near[np.arange(len(near)), np.arange(first, first + len(near))] = False
        for part in self.parts.T:
            near &= part[rows, None] != part
        return near

    def candidates(self, allowed: int) -> np.ndarray:
        """Rows of which a counted pair's codes differ in few enough bits."""
        found = np.zeros(len(self.ids), dtype=bool)
        for a in range(0, len(self.ids), 512):
            off = sum(np.bitwise_count(self.code[a : a + 512, None, w] ^ self.code[:, w]).astype(np.int16) for w in range(self.code.shape[1]))
            found |= self.counted(off <= allowed, a).any(axis=0)
        return np.flatnonzero(found)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, at_once: int = 256, block: int = 384, sample_rows: int = 6_000, work: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors of equal labels are linked when their cosine, in double precision,
    is at least ``least``. Candidates share a substring of their codes, of a
    length and in as many tables as layout() says, or more where fit_codes()
    finds that the codes of these vectors need them: with 8 tables of 8 bits
    every pair within 7 bits of 64 is found and nearly all within 12, while at
    cosine 0.93 about 8 bits differ. Every vector is indexed; only the rotation
    is learned from about ``sample_rows`` of them.

    Equal vectors of a label are one class from the start, counted. A bucket is
    dealt into blocks whose pairs meet in groups of at most about two blocks:
    first the codes alone, then, of rows that have a pair whose codes are close
    enough, the vectors, in the width that the table has them. From there go
    each vector's number of links (a pair counts in the first table that holds
    it) and a forest of the links, never the pairs.

    Vectors that are null, zero, empty or hold null or non-finite components,
    and rows with a null label or id, link with nothing. Vectors of different
    dimensions are not compared. Repeated rows keep a row each and count as
    each other's links; an empty table gives an empty one; further columns of
    any name are left out.
    """
    spark = df.sparkSession
    work = work or Scratch(spark)
    given = pick(df, vec_id=id_col, vector=vector_col, label=label_col)
    wide = "float" if given.schema["vector"].dataType.elementType.typeName() == "float" else "double"
    kind = np.float32 if wide == "float" else np.float64
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast(f"array<{wide}>").alias("vector"), F.col("label").cast("string").alias("label"))
    live = given.where("vec_id is not null and label is not null and vector is not null")
    each, tables = layout(live.groupBy("label").count().agg(F.max("count")).first()[0] or 0, least, at_once=at_once)
    sample = sample_of(live, sample_rows)
    codes, tables, allowed = (None, tables, 0) if sample is None else fit_codes(sample, each, tables, least)
    shared = spark.sparkContext.broadcast(codes)  # dimensions x bits numbers

    def pack(values: list) -> list[list]:
        """As bytes, with a fingerprint of them."""
        out: list[list] = [[], [], []]
        for v in map(as_vector, values):
            raw = (v + 0.0).astype(kind).tobytes() if v is not None and v.any() else None
            fp = np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64) if raw else None
            for c, x in zip(out, (raw, int(fp[0]), int(fp[1])) if raw else (None, None, None), strict=True):
                c.append(x)
        return out

    def encode(values: list) -> list[list]:
        raw, one, two = pack(values)
        good = [k for k, r in enumerate(raw) if r is not None]
        code: list = [None] * len(values)
        if good and shared.value is not None:
            bits = np.packbits(shared.value.code([np.frombuffer(raw[k], kind).astype(np.float64) for k in good]), axis=1)
            for k, b in zip(good, bits, strict=True):
                code[k] = b.tobytes()
        return [one, two, code]

    rows = work.save(with_columns(given, "vector", lambda: encode, "fp1 long, fp2 long, code binary").drop("vector"), "codes")
    usable = rows.where("code is not null and label is not null and vec_id is not null")
    classes = work.save(usable.groupBy("label", "fp1", "fp2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("code").alias("code")), "classes")
    fields = "bucket long, t int, vec_id long, fp1 long, n long, lab long, code binary"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                parts = substrings(np.unpackbits(raw, axis=1), each, tables).astype(np.uint64)
                lab = batch.column("lab").to_numpy().view(np.uint64)
                for t in range(tables):
                    key = _mixed(_mixed(lab + np.uint64(t)) + parts[:, t])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(batch.num_rows, t, np.int32)), *(batch.column(c) for c in ("vec_id", "fp1", "n", "lab", "code"))], names=["bucket", "t", "vec_id", "fp1", "n", "lab", "code"])

    entries = classes.select("vec_id", "fp1", "n", F.xxhash64("label").alias("lab"), "code").mapInArrow(spread, fields)
    hot = work.save(entries.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > block), "hot")
    dealt = entries.join(F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot.hint("merge"), "bucket", "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "vec_id", "fp1", "n", "lab", "code")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            if len(run) > 1 and len(some := _Group(run, each).candidates(allowed)):
                yield from run.take(pa.array(some)).combine_chunks().to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            group, raw = _Group(run, each), [np.frombuffer(v, kind).astype(np.float64) for v in run.column("vec").to_pylist()]
            names, fp = np.unique(np.array(run.column("label").to_pylist()), return_inverse=True)[1], run.column("fp1").to_numpy()
            links, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
            near = np.zeros((len(raw), len(raw)), dtype=bool)
            for dim in {len(v) for v in raw}:
                at = np.array([k for k, v in enumerate(raw) if len(v) == dim])
                unit = np.stack([raw[k] for k in at])
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                near[np.ix_(at, at)] = unit @ unit.T >= least
            near = group.counted(near & (names[:, None] == names), 0)
            links = near @ group.n
            while True:  # each takes the least place among its neighbours', until none changes
                best = np.minimum(root, np.where(near, root[None, :], len(raw)).min(axis=1, initial=len(raw)))
                if (best == root).all():
                    break
                root = best
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(group.ids[some]), pa.array(fp[some]), pa.array(links[some]), pa.array(group.ids[root[some]])], names=["vec_id", "fp1", "links", "peer"])

    group = ["bucket", "i", "j"]
    ordered = lambda t: t.repartition(*group).sortWithinPartitions(*group)
    kept = "bucket long, i int, j int, own int, t int, vec_id long, fp1 long, n long, lab long, code binary"
    members = work.save(ordered(dealt).mapInArrow(close, kept), "members")
    one = members.select("vec_id", "fp1", "lab").distinct()
    vectors = with_columns(live.withColumn("lab", F.xxhash64("label")), "vector", lambda: pack, "vec binary, fp1 long, fp2 long").select("vec_id", "fp1", "lab", "label", "vec")
    vectors = vectors.join(one.hint("merge"), ["vec_id", "fp1", "lab"], "left_semi").dropDuplicates(["vec_id", "fp1", "lab"])
    met = members.join(vectors.hint("merge"), ["vec_id", "fp1", "lab"]).select(*group, "own", "t", "vec_id", "fp1", "n", "lab", "code", "label", "vec")
    parts = work.save(ordered(met).mapInArrow(link, "vec_id long, fp1 long, links long, peer long"), "links")
    found = components(parts.select(F.col("vec_id").alias("a"), F.col("peer").alias("b")), work)
    counts = parts.groupBy("vec_id", "fp1").agg(F.sum("links").alias("links"))
    named = classes.select("label", "fp1", "fp2", "n", "vec_id").join(counts.hint("merge"), ["vec_id", "fp1"], "left").join(found.withColumnRenamed("node", "vec_id").hint("merge"), "vec_id", "left")
    named = work.save(named.select("label", "fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "named")
    work.drop(classes, hot, members, parts)
    ok = F.col("code").isNotNull() & F.col("vec_id").isNotNull()
    out = rows.select("vec_id", "label", F.when(ok, F.col("fp1")).alias("fp1"), "fp2").join(named.hint("merge"), ["label", "fp1", "fp2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
