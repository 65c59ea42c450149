"""Sharding by histogram sort: exact byte counts below probes, refined until the splitters are good; one exchange."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from actfold.llm.common import Scratch, numbered, pick

_WIDE = _LOW = 1 << 63  # row numbers are below 2**63, so every packed integer is a (key, uid)


def _pack(key: int, uid: int) -> int:
    """(key, uid) as one integer of the same order."""
    return (key + _LOW) * _WIDE + uid


def _unpack(x: int) -> tuple[int, int]:
    key, uid = divmod(x, _WIDE)
    return key - _LOW, uid


def _cell(keys: np.ndarray, uids: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """How many probes are at or below each (key, uid); probes ascend."""
    pk = np.array([p[0] for p in probes], dtype=np.int64)
    pu = np.array([p[1] for p in probes], dtype=np.int64)
    left, cell = np.searchsorted(pk, keys, "left"), np.searchsorted(pk, keys, "right")
    tied = left < cell
    for i in np.unique(left[tied]):  # keys that equal a probe's: their uid decides
        rows = tied & (left == i)
        cell[rows] = i + np.searchsorted(pu[i : cell[rows][0]], uids[rows], "right")
    return cell


Cell = tuple[int, int, tuple[int, int], tuple[int, int]]


def _counts(slim: DataFrame, probes: list[tuple[int, int]]) -> dict[int, Cell]:
    """Exact bytes and rows, the first and the last (key, uid), of every cell between probes that holds rows."""

    @F.pandas_udf(T.IntegerType())
    def cell(key: pd.Series, uid: pd.Series) -> pd.Series:
        return pd.Series(_cell(key.to_numpy(), uid.to_numpy(), probes).astype(np.int32))

    at = F.struct("key", "uid")
    found = slim.groupBy(cell("key", "uid").alias("cell")).agg(F.sum("size"), F.count("*"), F.min(at), F.max(at)).collect()
    return {r[0]: (int(r[1]), int(r[2]), tuple(r[3]), tuple(r[4])) for r in found}


class Histogram:
    """Exact bytes and rows below every probe, and the ranges that hold rows, refined pass by pass."""

    def __init__(self, slim: DataFrame):
        self.slim = slim
        low, high, size, rows = slim.agg(F.min(F.struct("key", "uid")), F.max(F.struct("key", "uid")), F.sum("size"), F.count("*")).first()
        first, last = _pack(*low), _pack(*high)
        #: Intervals of rows, ascending: (first, last, bytes, rows), both ends being rows.
        self.parts: list[tuple[int, int, int, int]] = [(first, last, int(size), rows)]

    def refine(self, wanted: dict[int, set[int]]) -> None:
        """Splits intervals (by their place) at probes, in one counting pass over all of them."""
        ends = {x for i in wanted for x in (self.parts[i][0], self.parts[i][1] + 1) if x < _pack(_LOW, 0)}
        probes = sorted(ends.union(*wanted.values()))
        cells = _counts(self.slim, [_unpack(x) for x in probes])
        new = [p for i, p in enumerate(self.parts) if i not in wanted]
        for i in wanted:
            first, last, _, _ = self.parts[i]
            for k in range(bisect_right(probes, first), bisect_right(probes, last) + 1):
                if k in cells:
                    size, rows, low, high = cells[k]
                    new.append((_pack(*low), _pack(*high), size, rows))
        self.parts = sorted(new)


def _even(first: int, last: int, n: int) -> set[int]:
    """n probes that cut a range evenly, none at or below its first row."""
    return {first + 1 + (last - first - 1) * j // (n + 1) for j in range(1, n + 1)}


def splitters(hist: Histogram, n_shards: int, tolerance: float, run_rows: int, probes_each: int = 5) -> list[int]:
    """Refines until every splitter is good and every interval short, and returns the splitters.

    A splitter is good when the bytes below it are within ``tolerance`` of a
    shard's share, or when no row lies between it and the next. An interval is
    short when it holds at most ``run_rows`` rows. Each round counts, in one
    pass, below a few probes inside every interval that is not yet fine: one
    where the bytes would fall if rows were even, the rest evenly spaced over
    the range that rows take there, so one hot key or a gap costs no rounds.
    """
    total = sum(p[2] for p in hist.parts)
    slack = tolerance * total / n_shards
    targets = [total * i / n_shards for i in range(1, n_shards)]
    while True:
        below = np.cumsum([0, *(p[2] for p in hist.parts)])
        wanted: dict[int, set[int]] = {}
        for t in targets:
            i = min(int(np.searchsorted(below, t, "right")) - 1, len(hist.parts) - 1)
            first, last, size, rows = hist.parts[i]
            if rows > 1 and min(t - below[i], below[i + 1] - t) > slack:
                even = first + 1 + int((last - first - 1) * (t - below[i]) / max(1, size))
                wanted.setdefault(i, set()).update({min(max(even, first + 1), last)} | _even(first, last, probes_each))
        for i, (first, last, _, rows) in enumerate(hist.parts):
            if rows > run_rows:
                wanted.setdefault(i, set()).update(_even(first, last, 2 * (rows // run_rows) + 1))
        if not wanted:
            break
        hist.refine(wanted)
    starts = [p[0] for p in hist.parts]
    out = []
    for t in targets:  # the nearest edge between intervals
        i = int(np.searchsorted(below, t, "right")) - 1
        i = min(i + (i + 1 < len(below) and below[i + 1] - t < t - below[i]), len(starts))
        out.append(starts[i] if i < len(starts) else hist.parts[-1][1] + 1)
    return out


def shard(df: DataFrame, n_shards: int = 40, key_col: str = "doc_id", size_col: str = "size", tolerance: float = 0.002, run_rows: int = 200_000, work: Scratch | None = None) -> DataFrame:
    """Every row with its shard and its slot there, shards near equal in bytes.

    Rows are in the order of the key, those with equal keys in the order they
    are read; a key that holds more than a shard is cut between rows. Null keys
    come first, null sizes count 0. Further columns of any name pass through;
    the columns shard and slot are added (and replace columns so named). An
    empty table gives an empty one.

    The rows are written once with a number each, so that later passes and
    retried tasks see the same order. Counting passes read the key, number and
    size only; they go on until runs between probes hold at most ``run_rows``
    rows. The one exchange deals out these runs; since the rows before each run
    are counted, a slot is the run's start plus the row's place in it, and no
    task sorts more than a run at a time.
    """
    own, at = numbered(df)
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in ("shard", "slot")]
    names = [*(df.columns[i] for i in keep), "shard", "slot"]
    work = work or Scratch(df.sparkSession)
    key, size = F.coalesce(F.col(at[key_col]).cast("long"), F.lit(-_LOW)), F.coalesce(F.col(at[size_col]).cast("long"), F.lit(0))
    rows = work.save(own.select(F.struct(*[own.columns[i] for i in keep]).alias("row"), key.alias("key"), size.alias("size"), F.monotonically_increasing_id().alias("uid")), "rows")
    if rows.isEmpty():
        return rows.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0).toDF(*names)
    hist = Histogram(rows.select("key", "uid", "size"))
    cuts = splitters(hist, n_shards, tolerance, run_rows)
    runs, held = [], 0  # neighbouring intervals of a shard are joined while they stay within a run
    for first, _, _, n in hist.parts:
        s = bisect_right(cuts, first)
        if runs and runs[-1][1] == s and runs[-1][3] + n <= run_rows:
            runs[-1][3] += n
        else:
            runs.append([first, s, held, n])
        held += n
    begins: dict[int, int] = {}
    for _, s, before, _ in runs:
        begins.setdefault(s, before)
    shards = np.array([r[1] for r in runs], dtype=np.int32)
    offset = np.array([r[2] - begins[r[1]] for r in runs], dtype=np.int64)
    probes = [_unpack(r[0]) for r in runs[1:]]

    @F.pandas_udf("run int, shard int, offset long")
    def place(key: pd.Series, uid: pd.Series) -> pd.DataFrame:
        run = _cell(key.to_numpy(), uid.to_numpy(), probes)
        return pd.DataFrame({"run": run.astype(np.int32), "shard": shards[run], "offset": offset[run]})

    placed = rows.select("row", "key", "uid", place("key", "uid").alias("at"))
    slot = F.row_number().over(Window.partitionBy(F.col("at.run")).orderBy("key", "uid"))
    return placed.select("row.*", F.col("at.shard").alias("shard"), (F.col("at.offset") + slot - 1).alias("slot")).toDF(*names)


def query_rows(docs: DataFrame) -> DataFrame:
    """Size and checksum of each document, which is all that the sharding query moves."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
