"""Conversation prefixes in double-array tries, a trie for each shard, and nodes that shards share merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from actfold.llm.common import Scratch, pick, short_batches

WORDS = "[^\x20\x09-\x0d]+"
#: Bytes of a turn's key.
KEY = 16
SEQUENCE = "part int, sub int, lcp int, next int, conv_id long, keys binary, words array<int>"
SUMS = ("n_convs", "n_children", "n_leaves", "words_below", "words_owned")
#: A node as one shard knows it, or (``ends`` not null) a piece of the ids that end at a shared node.
NODE = "node binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, words_below long, words_owned long, ends_sha256 string, part int, sub int, piece int, ends binary"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie in two arrays: the child of slot s by id c is BASE[s] + c, if CHECK there is s. Slot 0 is the root."""

    FREE = -2

    def __init__(self, room: int = 1024):
        self.base, self.check = np.zeros(room, dtype=np.int64), np.full(room, self.FREE, dtype=np.int64)
        self.check[0], self.low, self.top = -1, 1, 1

    def _grow(self, room: int) -> None:
        if room > len(self.check):
            more = max(room, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int64)))
            self.check = np.concatenate((self.check, np.full(more, self.FREE, dtype=np.int64)))

    def _fit(self, ids: np.ndarray, tries: int = 64) -> int:
        """A base by which all ids meet free slots: the first of some free slots that does, else beyond all that are taken."""
        span = int(ids[-1] - ids[0]) + 1
        self._grow(self.top + span)
        free = self.low + np.flatnonzero(self.check[self.low : self.top] == self.FREE)[:tries]
        for s in free.tolist():
            self._grow(s + span)
            if (self.check[s + ids - ids[0]] == self.FREE).all():
                return s - int(ids[0])
        return self.top - int(ids[0])

    def add(self, parents: np.ndarray, ids: np.ndarray) -> None:
        """Children of one depth: distinct (parent, id), ascending; none of the parents has children yet."""
        first = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        sizes = np.diff(np.append(first, len(parents)))
        for k in np.flatnonzero(sizes > 1).tolist():
            own = ids[first[k] : first[k] + sizes[k]]
            s = int(parents[first[k]])
            self.base[s] = self._fit(own)
            slots = self.base[s] + own
            self.check[slots] = s
            self.top = max(self.top, int(slots[-1]) + 1)
        single = first[sizes == 1]
        self._grow(self.top + len(single))
        slots = self.low + np.flatnonzero(self.check[self.low : self.top + len(single)] == self.FREE)[: len(single)]
        if len(slots):
            self.base[parents[single]] = slots - ids[single]
            self.check[slots] = parents[single]
            self.top = max(self.top, int(slots[-1]) + 1)
        gaps = np.flatnonzero(self.check[self.low : self.top] == self.FREE)
        self.low = self.low + int(gaps[0]) if len(gaps) else self.top

    def child(self, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The child of each slot by each id, -1 where there is none."""
        to = self.base[slots] + ids
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def dense(keys: list[bytes], by_depth: np.ndarray) -> np.ndarray:
    """Turn ids from 0 in the order in which depth after depth meets the turns, so that siblings have ids close to each other."""
    seen: dict[bytes, int] = {}
    out = np.empty(len(keys), dtype=np.int64)
    for k in by_depth.tolist():
        out[k] = seen.setdefault(keys[k], len(seen))
    return out


def packed_trie(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> DoubleArray:
    """The trie of the sequences ids[start : start + size], built depth by depth."""
    trie, at, on = DoubleArray(), np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes))
    for d in range(int(sizes.max(initial=0))):
        on = on[sizes[on] > d]
        edges = np.unique(at[on] << 32 | ids[starts[on] + d])
        trie.add(edges >> 32, edges & 0xFFFFFFFF)
        at[on] = trie.child(at[on], ids[starts[on] + d])
    return trie


def walked(trie: DoubleArray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slot that each turn of each sequence leads to."""
    out, at, on = np.empty(len(ids), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes))
    for d in range(int(sizes.max(initial=0))):
        on = on[sizes[on] > d]
        at[on] = out[starts[on] + d] = trie.child(at[on], ids[starts[on] + d])
    return out


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x, y = (np.frombuffer(s, dtype=np.uint8, count=n) for s in (a, b))
    return int(np.argmax(x != y)) // KEY


def _named(keys: bytes, depth: int) -> list[bytes]:
    """Names of the nodes at depths 0 to ``depth`` of a sequence: each a digest of its parent's and its turn's key."""
    out = [hashlib.blake2b(b"", digest_size=KEY).digest()]
    for d in range(depth):
        out.append(hashlib.blake2b(out[-1] + keys[d * KEY : (d + 1) * KEY], digest_size=KEY).digest())
    return out


def shard_nodes(conv_ids: list[int], keys: list[bytes], words: list[list[int]], before: int, after: int, part: int = 0, sub: int = 0, piece: int = 8_000) -> list[dict]:
    """Nodes of one shard: sequences in order, copies by conversation.

    ``before`` is how many turns the first sequence shares with the one before
    the shard, ``after`` how many the last shares with the one after it; -1
    where there is none. Since sequences are in order, only nodes down to there
    on the first and the last path are in other shards too. Sums are made so
    that a shared node's are those of its shards added: a node's own words and
    its place among its parent's children count where it is first met, a leaf
    where it is last met.
    """
    sizes = np.array([len(k) // KEY for k in keys], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = b"".join(keys)
    turn = [flat[i : i + KEY] for i in range(0, len(flat), KEY)]
    depth = np.arange(len(turn)) - np.repeat(starts, sizes) + 1
    ids = dense(turn, np.argsort(depth, kind="stable"))
    trie = packed_trie(ids, starts, sizes)
    slots = walked(trie, ids, starts, sizes)
    n = trie.top
    conv, of = np.array(conv_ids, dtype=np.int64), np.repeat(np.arange(len(keys)), sizes)
    own = np.array([w for x in words for w in x], dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(own)))
    rest = np.repeat(total[starts + sizes], sizes) - total[:-1]  # words from each turn on
    nodes = np.concatenate(([0], np.unique(slots)))
    at_depth, word, least = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    at_depth[slots], word[slots] = depth, own
    np.minimum.at(least, slots, conv[of])
    least[0] = conv.min()
    convs, below = np.bincount(slots, minlength=n), np.zeros(n, dtype=np.int64)
    np.add.at(below, slots, rest)
    convs[0], below[0] = len(keys), total[-1]

    first, last = (np.concatenate(([0], slots[starts[k] : starts[k] + sizes[k]])) for k in (0, len(keys) - 1))
    shared, owned, leaf = np.zeros(n, dtype=bool), np.ones(n, dtype=bool), np.bincount(trie.check[nodes[1:]], minlength=n) == 0
    owned[first[: before + 1]] = False
    leaf[last[: after + 1]] = False
    shared[first[: before + 1]] = shared[last[: after + 1]] = True
    named = {}
    for path, k, most in ((first, 0, before), (last, len(keys) - 1, after)):
        if most >= 0:
            named |= dict(zip(path[: most + 1].tolist(), _named(keys[k], most), strict=True))
    children = np.bincount(trie.check[nodes[1:]], weights=owned[nodes[1:]], minlength=n).astype(np.int64)
    words_owned, leaves = word * owned, leaf.astype(np.int64)
    by_depth = nodes[np.argsort(at_depth[nodes], kind="stable")]
    edges = np.searchsorted(at_depth[by_depth], np.arange(1, at_depth.max(initial=0) + 2))
    for lo, hi in zip(edges[-2::-1].tolist(), edges[:0:-1].tolist(), strict=True):  # deepest first
        low = by_depth[lo:hi]
        np.add.at(words_owned, trie.check[low], words_owned[low])
        np.add.at(leaves, trie.check[low], leaves[low])

    ends: dict[int, list[str]] = {}
    for c, s, m in zip(conv_ids, starts.tolist(), sizes.tolist(), strict=True):
        ends.setdefault(int(slots[s + m - 1]) if m else 0, []).append(str(c))
    out = []
    for s in nodes.tolist():
        up = int(trie.check[s])
        row = {"depth": int(at_depth[s]), "conv_id": int(least[s]), "n_convs": int(convs[s]), "n_children": int(children[s]), "n_leaves": int(leaves[s]), "words_below": int(below[s]), "words_owned": int(words_owned[s]), "part": part, "sub": sub}
        if up >= 0:
            row |= {"parent": named[up]} if shared[up] else {"parent_conv_id": int(least[up])}
        if not shared[s]:
            row["ends_sha256"] = hashlib.sha256(",".join(ends[s]).encode()).hexdigest() if s in ends else NO_ENDS
        else:
            row["node"] = named[s]
            some = ends.get(s, [])
            out += [{"node": named[s], "part": part, "sub": sub, "piece": k, "ends": ",".join(some[k : k + piece]).encode()} for k in range(0, len(some), piece)]
        out.append(row)
    return out


def sequences(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, work: Scratch, family: int = 20) -> DataFrame:
    """conv_id, keys (of all rebuilt turns, joined) and words (of each) of every conversation.

    Texts go no further than here: a turn is 16 bytes of a digest of its role
    and text from now on.
    """
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.regexp_count(text, F.lit(WORDS)).alias("words"))
    own = work.save(slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("turns")), "turns")
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 3).alias("head"))
    own = own.withColumns({"head_id": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")})
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    rebuilt = own.join(heads.hint("merge"), "head_id", "left").select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest)).alias("turns"))
    return work.save(rebuilt.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["key"]), "")).alias("keys"), F.transform("turns", lambda x: x["words"]).alias("words")), "sequences")


def in_order(seqs: DataFrame, shard_turns: int, work: Scratch) -> DataFrame:
    """Sequences in order over all partitions, copies by conversation, cut into shards (part, sub) of about ``shard_turns`` turns.

    lcp and next tell how many turns a row shares with the one before and after
    it in its partition, -1 at the partition's ends.
    """
    schema = T._parse_datatype_string(SEQUENCE)
    fields = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sub, turns, held = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            rows = []
            for conv_id, keys, words in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "keys", "words")), strict=True):
                lcp = -1
                if held is not None:
                    lcp = held[3] = common(held[5], keys)
                    rows.append(held)
                if turns and turns + len(words) > shard_turns:
                    sub, turns = sub + 1, 0
                turns += len(words) + 1
                held = [part, sub, lcp, -1, conv_id, keys, words]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields, strict=True)], schema=fields)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(held, fields, strict=True)], schema=fields)

    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return work.save(seqs.repartitionByRange(n, "keys", "conv_id").sortWithinPartitions("keys", "conv_id").mapInArrow(cut, schema), "ordered")


def joints(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition with rows, the turns its first and last sequence share with their neighbours in other partitions (-1: none).

    Two rows a partition are read, one after the other.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = None, None
        for batch in batches:
            rows = []
            for p, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if before is not None and p != part:
                    rows.append((part, p, common(before, keys)))
                before, part = keys, p
            yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in rows], pa.int32()) for k, n in enumerate(("low", "high", "lcp"))})

    ends = ordered.where("lcp = -1 or next = -1").select("part", "keys", "lcp").repartition(1).sortWithinPartitions("part", F.col("lcp") >= 0, "keys").select("part", "keys")
    out = {r.part: (-1, -1) for r in ordered.where("lcp = -1").select("part").collect()}
    for low, high, lcp in ends.mapInArrow(meet, "low int, high int, lcp int").collect():
        out[low], out[high] = (out[low][0], lcp), (lcp, out[high][1])
    return out


def _hashed(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256 of shared nodes, their pieces read one after the other with no more than a batch in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        out = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})
        for batch in batches:
            for name, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name == node:
                    state.update(b",")
                else:
                    if node is not None:
                        yield out()
                    node, state = name, hashlib.sha256()
                state.update(ends)
        if node is not None:
            yield out()

    return pieces.repartition("node").sortWithinPartitions("node", "part", "sub", "piece").select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = 200_000, work: Scratch | None = None) -> DataFrame:
    """One row a node of the trie of rebuilt conversations, with the columns of TRIE.

    A conversation's turns go by ``turn``, null first, those with equal turns
    by a digest of role and text. Null role and text are empty; a repeated row
    is a further turn. Rows without a conversation are in none and left out. An
    empty table gives no node, also no root. Other columns are left out.

    Sequences are put in order over all partitions and cut into shards, so hot
    turns, prefixes and copies are spread like all others, and a shard shares
    nodes with others on its first and last path only. Each shard packs a
    double array over ids of its own turns, walks it, and sums what its nodes
    have; shared nodes are merged by a digest of their path. A conversation is
    one row of about 20 bytes a turn, a shard about ``shard_turns`` turns or
    one longer conversation.
    """
    work = work or Scratch(df.sparkSession)
    short_batches(df.sparkSession)
    ordered = in_order(sequences(df, conv_col, turn_col, role_col, text_col, work), shard_turns, work)
    meets = joints(ordered)
    schema = T._parse_datatype_string(NODE)
    fields = to_arrow_schema(schema)

    def nodes_of(shard: pa.Table) -> pa.Table:
        rows = sorted(zip(*(shard[n].to_pylist() for n in ("keys", "conv_id", "words", "lcp", "next", "part", "sub")), strict=True), key=lambda r: r[:2])
        part, sub = rows[0][5:]
        before, after = rows[0][3], rows[-1][4]
        before, after = meets[part][0] if before < 0 else before, meets[part][1] if after < 0 else after
        found = shard_nodes([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows], before, after, part, sub)
        return pa.Table.from_arrays([pa.array([r.get(f.name) for r in found], type=f.type) for f in fields], schema=fields)

    nodes = work.save(ordered.groupBy("part", "sub").applyInArrow(nodes_of, schema), "nodes")
    shared = nodes.where("node is not null and ends is null").groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
    shared = work.save(shared.join(_hashed(nodes.where("ends is not null")).hint("merge"), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "shared")
    own = nodes.where("node is null")
    rows = ["parent", "depth", "conv_id", *SUMS, "ends_sha256"]
    above = shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = own.where("parent is not null").select(rows).union(shared.where("parent is not null").select(rows)).join(above.hint("merge"), "parent")
    alone = own.where("parent is null").select(*rows, "parent_conv_id").union(shared.where("parent is null").select(*rows, F.lit(None).cast("long")))
    return linked.select(*rows, "parent_conv_id").union(alone).withColumn("saved_tokens", F.col("words_below") - F.col("words_owned")).select(*TRIE)
