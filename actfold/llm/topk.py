"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from actfold.llm.common import Scratch, pick, with_columns
from actfold.llm.embeddings import as_vector

NO_CUT = -(1 << 62)
#: Stands for scores that fit no long; scaled components are at most WIDEST, the largest number below 2**63 in double precision.
FULL, WIDEST = (1 << 63) - 1, float((1 << 63) - 1024)
#: Groups of equal vectors are broadcast only up to this many.
MOST_BROADCAST = 50_000


def _blocks(rows: DataFrame, size: int, most_bytes: int = 1 << 25) -> DataFrame:
    """block, n, dim, wide, ids, cells: rows(vec_id, vec, wide) packed as bytes, up to ``size`` of one dimension and width, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = TaskContext.get().partitionId() << 32, {}

        def flush(kind: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal first
            ids, vecs = zip(*held.pop(kind), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, len(ids), *kind, np.array(ids, np.int64).tobytes(), b"".join(vecs))], names=["block", "n", "dim", "wide", "ids", "cells"])
            first += 1
            return out

        for batch in batches:
            for i, v, wide in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "vec", "wide")), strict=True):
                kind = (len(v) // (8 if wide else 4), wide)
                held.setdefault(kind, []).append((i, v))
                if len(held[kind]) >= size or len(held[kind]) * len(v) >= most_bytes:
                    yield flush(kind)
        for kind in list(held):
            yield flush(kind)

    return rows.select("vec_id", "vec", "wide").mapInArrow(run, "block long, n long, dim long, wide boolean, ids binary, cells binary")


def _matrix(cells: bytes, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(cells, np.int64 if wide else np.int32).reshape(-1, dim).astype(np.int64, copy=False)


def _distinct(rows: DataFrame, most: int | None, work: Scratch) -> DataFrame:
    """rows(vec_id, vec, wide, fp1, fp2) without repeated ones, and of equal vectors the ``most`` smallest ids.

    Counting needs ids and fingerprints only. Where there are groups of more
    than ``most`` equal vectors, their least ids are found and joined back (by
    broadcast while there are few such groups); no vector moves for it.
    """
    if most is not None:
        slim = rows.select("fp1", "fp2", "vec_id")
        hot = work.save(slim.groupBy("fp1", "fp2").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot")
        if n_hot := hot.count():
            near = (lambda t: F.broadcast(t)) if n_hot <= MOST_BROADCAST else (lambda t: t.hint("merge"))
            nth = F.row_number().over(Window.partitionBy("fp1", "fp2").orderBy("vec_id"))
            least = slim.join(near(hot.select("fp1", "fp2")), ["fp1", "fp2"], "left_semi").distinct().withColumn("nth", nth).where(F.col("nth") <= most)
            bound = work.save(least.groupBy("fp1", "fp2").agg(F.max("vec_id").alias("last")), "least")
            rows = rows.join(near(bound), ["fp1", "fp2"], "left").where("last is null or vec_id <= last").drop("last")
    if rows.select("vec_id", "fp1", "fp2").groupBy("vec_id", "fp1", "fp2").count().where("count > 1").isEmpty():
        return rows
    return rows.dropDuplicates(["vec_id", "fp1", "fp2"])


def _most(q: np.ndarray, x: np.ndarray) -> int:
    """No inner product of the two, nor a part of one, is larger than this."""
    high = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    return high(q) * high(x) * q.shape[1]


def _product(q: np.ndarray, x: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Exact integer inner products: in floating point where every sum fits in 53 bits, which is faster.

    Products of FULL and beyond become FULL with their sign. Integer sums wrap,
    but what they wrap to is exact if the true sum fits; whether it does is told
    by the sum in floating point, or, near the limit or where its error may be
    large, by Python's integers. Pairs in ``own`` are a vector and itself, which nobody
    asks for; they may be anything.
    """
    most = _most(q, x)
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    out = q @ x.T
    if most >= 2**63:
        near = q.astype(np.float64) @ x.astype(np.float64).T
        unsure = np.abs(near) + np.float64(most) * (q.shape[1] + 2) * 2.0**-52 >= 2.0**62
        for i, j in np.argwhere(unsure if own is None else unsure & ~own).tolist():
            exact = sum(a * b for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))
            out[i, j] = max(-FULL, min(FULL, exact))
    return out


def _parts_of(q: np.ndarray, x: np.ndarray, slices: list[slice], own: np.ndarray | None = None) -> list[np.ndarray]:
    """Partial scores that sum to the totals: one for each part of the dimensions, or, where such a part might fit no long, the total and zeros."""
    if _most(q, x) < 2**62:
        return [_product(q[:, s], x[:, s]) for s in slices]
    total = _product(q, x, own)
    return [total] + [np.zeros_like(total)] * (len(slices) - 1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, lists: int = 2, query_block: int = 8192, row_block: int = 8192, at_once: int = 256, work: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows with another id. Components become floor(scale * x). Ties go to the
    smaller id. Vectors that are null or empty or hold null or non-finite
    components take no part, nor do null ids. Nothing ever wraps: a scaled
    component beyond a long counts as about 2**63 with its sign, and a score of
    2**63 - 1 and beyond, either way, ranks first or last, among such by id, and
    is given as null. Vectors of different dimensions are not compared; repeated rows are one
    candidate; further columns of any name are left out; an empty table gives
    an empty one.

    The dimensions are cut into ``lists`` parts; a node, a block of rows, keeps
    for each query a list of partial scores for each part.

    1. Every node sends the heads of its lists with their full scores; a
       query's k-th highest is its cutoff, which the true k-th cannot be below.
    2. A total at or above the cutoff has a part at or above cutoff / lists.
       Every node collects the entries that do; those in all lists are exact
       and may raise the cutoff.
    3. The others, unless what is known plus the cutoff's share for each
       unknown list stays below it, are resolved exactly, and the best sent.

    Rows and queries are packed into blocks of up to ``row_block`` and
    ``query_block`` of them (32 MB), components in 4 bytes where they fit. Every
    phase sends each block of rows once for each block of queries, of which
    there is one up to ``query_block`` queries, and scores ``at_once`` queries
    of a block at a time. Cutoffs travel with their block of queries. Of equal
    vectors only the k + 1 smallest ids can matter, so only those go on.
    """
    spark = df.sparkSession
    work = work or Scratch(spark)
    given = pick(df, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where("vec_id is not null")

    def whole(values: list) -> list[list]:
        out: list[list] = [[], [], [], []]
        for v in map(as_vector, values):
            x = np.clip(np.floor(scale * v), -WIDEST, WIDEST) if v is not None else None
            if x is None:
                row: tuple = (None, None, None, None)
            else:
                wide = bool(np.abs(x).max() >= 2**31)
                raw = x.astype(np.int64 if wide else np.int32).tobytes()
                row = (raw, wide, *np.frombuffer(xxhash.xxh3_128_digest(raw), np.int64).tolist())
            for c, y in zip(out, row, strict=True):
                c.append(y)
        return out

    rows = work.save(with_columns(given, "vector", lambda: whole, "vec binary, wide boolean, fp1 long, fp2 long").drop("vector").where("vec is not null"), "whole")
    few = _distinct(rows, k + 1, work)
    data = work.save(_blocks(few, row_block), "rows")
    asked = work.save(_distinct(rows.where(F.col("vec_id") % every == 0), None, work), "asked")
    n_asked, n_rows = asked.count(), data.agg(F.sum("n")).first()[0] or 0
    queries = work.save(_blocks(asked.coalesce(max(1, -(-n_asked // query_block))), query_block), "queries")
    residues, salts = max(1, queries.count()), max(1, -(-n_rows // row_block))
    # Every block of queries meets every block of rows: a copy of the rows for each residue of the
    # query block, a copy of the queries for each residue of the row block, so a group has a few of both.
    left = data.select(F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(residues - 1))).alias("qr"), F.col("block").alias("db"), "dim", "wide", "ids", "cells")
    asks = queries.select(F.pmod(F.xxhash64("block"), F.lit(residues)).cast("int").alias("qr"), F.col("block").alias("qb"), F.col("dim").alias("q_dim"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("cells").alias("q"))
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")

    def slices(dim: int) -> list[slice]:
        edges = [dim * p // lists for p in range(lists + 1)]
        return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def meet(right: DataFrame, work_on, schema: str) -> DataFrame:
        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            xs, qs = rows.to_pylist(), asked.to_pylist()
            for x in xs:
                for q in qs:
                    if x["dim"] == q["q_dim"] and q.get("db", x["db"]) == x["db"]:
                        ids, cells = np.frombuffer(x["ids"], np.int64), _matrix(x["cells"], x["dim"], x["wide"])
                        q_ids, asked = np.frombuffer(q["q_ids"], np.int64), _matrix(q["q"], x["dim"], q["q_wide"])
                        for a in range(0, len(q_ids), at_once):
                            out.append(pa.Table.from_pylist(work_on(x, q, ids, cells, q_ids[a : a + at_once], asked[a : a + at_once]), schema=fields))
            return pa.concat_tables(out) if out else fields.empty_table()

        fields = to_arrow_schema(T._parse_datatype_string(schema))
        return left.groupBy("qr", "salt").cogroup(right.groupBy("qr", "salt")).applyInArrow(run, schema)

    def heads(x: dict, q: dict, ids: np.ndarray, cells: np.ndarray, q_ids: np.ndarray, asked: np.ndarray) -> list[dict]:
        partial = _parts_of(asked, cells, slices(x["dim"]), q_ids[:, None] == ids)
        total, most = sum(partial), min(k + 1, len(ids))
        found = np.concatenate([np.argpartition(-p, most - 1, axis=1)[:, :most] for p in partial], axis=1)
        out = []
        for i, own in enumerate(q_ids):
            at = np.unique(found[i])
            at = at[ids[at] != own]
            out += [{"qb": q["qb"], "query_id": own, "vec_id": ids[a], "score": total[i, a]} for a in at[_best(total[i, at], ids[at], k)]]
        return out

    def cutoffs(scores: DataFrame) -> DataFrame:
        """qb, query_id, cut: the k-th highest score known for each query that has as many."""
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return scores.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select("qb", "query_id", F.col("score").alias("cut"))

    scores = "qb long, query_id long, vec_id long, score long"
    one = work.save(meet(asks.select("*", every_salt), heads, scores), "heads")
    cut = work.save(cutoffs(one), "cut")
    cuts = cut.groupBy("qb").agg(F.collect_list(F.struct("query_id", "cut")).alias("cuts"))  # a block's queries at most
    armed = work.save(asks.join(cuts.hint("merge"), "qb", "left"), "armed")

    def enough(x: dict, q: dict, ids: np.ndarray, cells: np.ndarray, q_ids: np.ndarray, asked: np.ndarray) -> list[dict]:
        cuts = {c["query_id"]: c["cut"] for c in q["cuts"] or []}
        bound = np.array([cuts.get(i, NO_CUT) for i in q_ids.tolist()], np.int64)
        partial = np.stack(_parts_of(asked, cells, slices(x["dim"]), q_ids[:, None] == ids))
        over = partial >= -(-bound // lists)[None, :, None]  # the cutoff's share, rounded up
        known, seen = np.where(over, partial, 0).sum(axis=0), over.sum(axis=0)
        out = []
        for i, own in enumerate(q_ids):
            at = np.flatnonzero(seen[i])
            at = at[ids[at] != own]
            full = at[seen[i, at] == lists]
            full = full[_best(known[i, full], ids[full], k)]
            rest = at[seen[i, at] < lists]
            if len(at):
                out.append({"qb": q["qb"], "db": x["db"], "query_id": own, "cut": bound[i], "exact": [{"vec_id": ids[a], "score": known[i, a]} for a in full], "open": [{"at": a, "known": known[i, a], "missing": lists - seen[i, a]} for a in rest]})
        return out

    two = work.save(meet(armed.select("*", every_salt), enough, "qb long, db long, query_id long, cut long, exact array<struct<vec_id:long,score:long>>, open array<struct<at:long,known:long,missing:long>>"), "entries")
    sure = work.save(one.union(two.select("qb", "query_id", F.explode("exact").alias("e")).select("qb", "query_id", "e.*")).distinct(), "sure")
    raised = cutoffs(sure).select("query_id", F.col("cut").alias("raised"))
    left_open = F.filter("open", lambda o: F.col("raised").isNull() | (o["known"].cast("decimal(38,0)") * lists + o["missing"] * F.col("cut").cast("decimal(20,0)") >= F.col("raised").cast("decimal(38,0)") * lists))
    wanted = two.where(F.size("open") > 0).join(raised.hint("merge"), "query_id", "left").withColumn("open", F.transform(left_open, lambda o: o["at"])).where(F.size("open") > 0)
    wanted = wanted.groupBy("qb", "db").agg(F.collect_list(F.struct("query_id", "open")).alias("wanted"))  # a block's queries, each with places in one block of rows
    wanted = work.save(wanted, "open")
    work.drop(rows, asked, one, cut, armed, two)
    wanted = wanted.withColumn("salt", F.pmod(F.xxhash64("db"), F.lit(salts)).cast("int")).join(asks.hint("merge"), "qb")

    def resolve(x: dict, q: dict, ids: np.ndarray, cells: np.ndarray, q_ids: np.ndarray, asked: np.ndarray) -> list[dict]:
        place, out = {i: n for n, i in enumerate(q_ids.tolist())}, []
        for w in q["wanted"]:
            if w["query_id"] not in place:
                continue
            at = np.array(w["open"], np.int64)
            total = _product(asked[place[w["query_id"]]][None, :], cells[at])[0]
            out += [{"qb": q["qb"], "query_id": w["query_id"], "vec_id": ids[at[b]], "score": total[b]} for b in _best(total, ids[at], k)]
        return out

    three = meet(wanted, resolve, scores)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every_score = sure.select("query_id", "vec_id", "score").union(three.select("query_id", "vec_id", "score")).distinct()
    fits = (F.col("score") < FULL) & (F.col("score") > -FULL)
    return every_score.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.when(fits, F.col("score")).alias("score"))
