"""Near-duplicate documents by circulant MinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import Scratch, components, kept, pick, with_columns

WORDS = 5
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of five words, hashed to 64 bits, ascending.

    Letters A-Z are lowered; words end at the ASCII space and the control
    characters 9 to 13, which is where bytes.lower() and bytes.split() do the
    same. Fewer words than five make one shingle together; no word, none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(kept("hashes", _Hashes).__getitem__, words), np.uint64, n)
    if n < WORDS:
        return _mix64((h * _TIMES[:n]).sum(keepdims=True) + np.uint64(n))
    s = h[: n - 4] * _TIMES[0]
    for k in range(1, WORDS):
        s += h[k : n - 4 + k] * _TIMES[k]
    return np.unique(_mix64(s + np.uint64(WORDS)))


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least value of the second permutation, shifted by k around the circle of 2**32 places, over the set under the first."""
    places = (_mix64(found ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(places), 512):
        x = places[None, a : a + 512] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for ascending sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (of the whole set), buckets (one for each band)."""

    def sketch(text: str | None) -> tuple:
        found = shingles(text)
        if not len(found):
            return 0, None, None, None
        fp = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64)
        sig = signature(found, bands * rows).astype(np.uint64).reshape(bands, rows)
        key = np.zeros(bands, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
        for k in range(rows):
            key = _mix64(key * _TIMES[0] + sig[:, k])
        return len(found), int(fp[0]), int(fp[1]), key.astype(np.int64)

    out = with_columns(docs, "text", lambda: lambda texts: [list(c) for c in zip(*map(sketch, texts), strict=True)] or [[]] * 4, "n_shingles long, fp1 long, fp2 long, buckets array<long>")
    return out.drop("text")


def sets_of(docs: DataFrame, ids: DataFrame, coordinates: int) -> DataFrame:
    """doc_id, shingles and sig (as bytes) of the documents in ids(doc_id)."""

    def run(texts: list) -> list[list]:
        found = [shingles(t) for t in texts]
        return [[x.tobytes() for x in found], [signature(x, coordinates).tobytes() for x in found]]

    mine = docs.join(ids.hint("merge"), "doc_id", "left_semi")
    if not mine.groupBy("doc_id").count().where("count > 1").isEmpty():  # of repeated rows one; different texts of one id are each compared
        mine = mine.dropDuplicates(["doc_id", "text"])
    return with_columns(mine, "text", lambda: run, "shingles binary, sig binary").select("doc_id", "shingles", "sig")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[good, ["a", "b"]]

    one = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(one.hint("merge"), "b").join(two.hint("merge"), "a").mapInPandas(run, "a long, b long")


def crossing(members: DataFrame, sets: DataFrame, percent: int, coordinates: int, block: int) -> DataFrame:
    """Links between different components inside a bucket: members(bucket, doc_id, component, n).

    A bucket of n rows is dealt into blocks, and every pair of blocks meets in
    one group of at most about two blocks of sets. There, pairs whose
    signatures agree in far fewer places than similar sets' do are passed over;
    the rest are compared in full unless they are connected by then, so what
    leaves a group is a forest.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component")
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / coordinates) ** 0.5

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, comp, own = group["doc_id"].to_numpy(), group["component"].to_numpy(), group["own"].to_numpy()
        found = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        sig = np.stack([np.frombuffer(x, np.uint32) for x in group["sig"]])
        root = {c: c for c in set(comp.tolist())}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        links, two = [], len(set(own.tolist())) > 1
        for a in range(len(ids) - 1):
            agree = (sig[a + 1 :] == sig[a]).mean(axis=1)
            for b in a + 1 + np.flatnonzero((agree >= least) & (comp[a + 1 :] != comp[a])):
                if two and own[a] == own[b] or top(comp[a]) == top(comp[b]):
                    continue
                if similar(found[a], found[b], percent):
                    root[top(comp[a])] = top(comp[b])
                    links.append((ids[a], ids[b]))
        return pd.DataFrame(links, columns=["a", "b"])

    return dealt.join(sets.hint("merge"), "doc_id").groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, bands: int = 20, rows: int = 5, block: int = 256, work: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Documents with 100 * intersection >= percent * union of their shingle sets
    are linked; a component is what links reach, named by its smallest id.
    With 20 bands of 5 rows a pair at 0.85 is missed with chance 8e-6.

    Rows with equal sets are one class from the start and only its smallest id
    goes on, so copies cost nothing further. In each bucket of a band, members
    are compared with the bucket's smallest id first. Buckets whose members are
    then in one component are done; in the others, every pair across components
    is settled by crossing().

    A null or wordless text has 0 shingles and, like a null id, stands alone;
    ties between ids do not arise, since the smallest is taken; repeated rows
    each keep a row; an empty table gives an empty one; other columns are left
    out.
    """
    spark = df.sparkSession
    work = work or Scratch(spark)
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows_of = work.save(sketches(docs, bands, rows), "sketches")
    linkable = rows_of.where("fp1 is not null and doc_id is not null")
    classes = work.save(linkable.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets")), "classes")
    spread = classes.select("rep", F.explode("buckets").alias("bucket"))
    shared = work.save(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1"), "shared")  # read again, so that a hot bucket's join can be split
    members = work.save(spread.join(shared.hint("merge"), "bucket").select("bucket", F.col("rep").alias("doc_id"), "n", "least"), "members")
    sets = work.save(sets_of(docs, members.select("doc_id").distinct(), bands * rows), "sets")
    stars = members.where("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = work.save(verified(stars, sets, percent), "links")
    found = work.save(components(links, work), "components")
    placed = members.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who")).where("low != high")
    mixed = mixed.groupBy("m", "who").agg(F.min("bucket").alias("bucket"))  # buckets of other bands with the same members
    open_members = work.save(placed.join(mixed.select("bucket").hint("merge"), "bucket", "left_semi"), "open")
    more = work.save(crossing(open_members, sets, percent, bands * rows, block), "crossing")
    if not more.isEmpty():
        first, found = found, work.save(components(links.union(more), work), "components")
        work.drop(first)
    named = classes.select("fp1", "fp2", "rep").join(found.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    named = work.save(named, "named")
    work.drop(classes, shared, members, sets, links, found, open_members, more)
    out = rows_of.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp1")).alias("fp1"), "fp2").join(named.hint("merge"), ["fp1", "fp2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
