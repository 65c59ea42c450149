"""Packing into token windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from actfold.llm.common import gathered, kept, pick, short_batches, text_chunks

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# What the tokenizer's own first cut makes of lower-case texts in Latin letters: letters, digits one by one, contractions, other marks.
_PIECE = r"[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zªµºß-öø-ɏ²³¹¼-¾]+"
#: A text that holds other characters, as it is or in lower case, or a special token's first marks, goes to the tokenizer whole.
_ODD = r"[^\t\n\r -~¡-ÿĀ-įĲ-ɏ]|<\|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceIds:
    """Token ids of texts as little-endian bytes, through a bounded cache of pieces.

    The default tokenizer lowers letters, drops white space and encodes each
    piece of its first cut on its own; so for texts in Latin letters the ids
    are those of the pieces, which recur. Other texts are encoded whole. The
    cache has two halves: pieces that are met move to the younger one, and
    when that is full the older one is dropped.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.half, self.young, self.old = Tokenizer.from_file(path), most // 2, {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Encodes a few hundred pieces as one text; every piece ends in a token that ends a word."""
        out: list[bytes] = []
        groups = [pieces[a : a + 256] for a in range(0, len(pieces), 256)]
        found = self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for some, got in zip(groups, found, strict=True):
            ids = np.array(got.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
            else:
                out += map(self.whole, some)
        return out

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        ids = list(map(self.young.get, pieces))
        late = [k for k, x in enumerate(ids) if x is None]
        new = []
        for k in late:
            if (x := self.old.get(pieces[k])) is None:
                new.append(k)
            else:
                ids[k] = x
        for k, x in zip(new, self.learn([pieces[k] for k in new]), strict=True):
            ids[k] = x
        if len(self.young) + len(late) > self.half:
            self.old, self.young = self.young, {}
        self.young.update((pieces[k], ids[k]) for k in late)
        return ids

    def __call__(self, texts: list) -> list[bytes]:
        out: list[bytes] = []
        for chunk in text_chunks(texts, 3_000_000):
            given = pa.array([t or "" for t in chunk], pa.large_string())
            lower = pc.utf8_lower(given)
            odd = pc.or_(pc.match_substring_regex(given, _ODD), pc.match_substring_regex(lower, _ODD))
            plain = pc.if_else(odd, "", lower)
            pieces = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, _PIECE, r"\0 "))
            coded = pieces.values.dictionary_encode()
            ids, at = self.of_pieces(coded.dictionary.to_pylist()), coded.indices.to_numpy()
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, starts, own = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes, sizes[at]
            ends = np.concatenate(([0], np.cumsum(own)))
            raw = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], own)].tobytes()
            cuts = (4 * ends[pieces.offsets.to_numpy()]).tolist()
            out += [self.whole(t) if o else raw[a:b] for t, o, a, b in zip(chunk, odd.to_pylist(), cuts, cuts[1:], strict=False)]
        return out


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(sum, items) of at most ``windows`` windows, near equal, largest first.

    Each item begins as a partition of its own, its other windows empty. The
    two partitions with the widest spread are merged again and again, the
    fullest windows of one with the emptiest of the other.
    """
    tie = count()
    heap = [(-s, next(tie), [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = max(0, len(a) + len(b) - windows)  # windows that are empty in neither
        merged = a[: len(a) - shared] + b[: len(b) - shared]
        if shared:
            merged += [(x + y, p + q) for (x, p), (y, q) in zip(a[-shared:], b[: -shared - 1 : -1], strict=True)]
        merged.sort(key=lambda w: -w[0])
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == windows else 0) - merged[0][0], next(tie), merged))
    return heap[0][2] if heap else []


def windows_of(lengths: list[int], capacity: int, piece: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length), each within the capacity.

    A document's full windows stand alone. What is left of it is cut into
    pieces, which differencing deals out; while any window is over the
    capacity, the number of windows rises. Neighbouring pieces of a document
    that meet in a window are joined again.
    """
    out, items = [], []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        out += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        items += [(d, s, min(piece, n - s)) for s in range(whole, n, piece)]
    if not items:
        return out
    k = -(-sum(x[2] for x in items) // capacity)
    while (parts := differencing([x[2] for x in items], k))[0][0] > capacity:
        k += 1
    for _, members in parts:
        window = []
        for d, s, n in sorted(items[i] for i in members):
            if window and window[-1][0] == d and window[-1][1] + window[-1][2] == s:
                s, n = window[-1][1], window.pop()[2] + n
            window.append((d, s, n))
        out.append(window)
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, encoder: Callable[[str], Callable[[list], list[bytes]]] = PieceIds, end_id: int = 1, capacity: int = 2048, piece: int = 512, group: int = 512) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then ``end_id``; a null or empty text is
    that id alone. Repeated rows, and rows with equal or null ids, are packed
    each on its own. An empty table gives no piece. Other columns are left out.

    Packing runs where the documents are read, so nothing is shuffled. A task
    packs ``group`` documents at a time. A sequence's id is made of
    the task's partition and a number, so a task that runs again makes the same
    ones. Each partition ends with one group that may fill its windows less.
    """
    docs, path = pick(df, doc_id=id_col, text=text_col), tokenizer or default_tokenizer()
    short_batches(df.sparkSession)
    schema = T._parse_datatype_string(PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = kept(f"ids {path}", lambda: encoder(path)), np.array([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 32
        held: list[tuple[object, bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal first
            rows = []
            for window in windows_of([len(ids) // 4 for _, ids in held], capacity, piece):
                at = 0
                for d, s, n in window:
                    ids = held[d][1]
                    rows.append((held[d][0], s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), len(ids) // 4, first, at))
                    at += n
                first += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields, strict=True)], schema=fields)

        for doc_ids, texts in gathered(batches):
            for doc_id, ids in zip(doc_ids, encode(texts), strict=True):
                held.append((doc_id, ids + end))
                if len(held) == group:
                    yield flush()
        if held:
            yield flush()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)
