"""Alignment of two tokenizers' tokens by interval coalescing, and how often ids are linked in the corpus."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from actfold.llm.common import Scratch, gathered, kept, pick, short_batches

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: A block of documents: what each has, its links as places in the block's distinct pairs (packed), and those pairs.
BLOCK = "block long, doc_ids array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<long>, places binary, times binary, pairs array<long>, held array<long>"
#: Stands where a text is cut into chunks; texts that hold it, or white space that the tokenizers may see in other ways, are one chunk.
_CUT = "\x00"
_ODD = "[\\x00\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Occurrence pairs of a group beyond which its ids are counted before they are paired.
_WIDE = 4096


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all intervals by start, and the group of each in that order.

    A group breaks where a start reaches the largest end so far.
    """
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends
    first = np.ones(len(order), dtype=bool)
    first[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(first) - 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(weight, first)


def link_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id pair (a in the upper half) and times of all links; the sides' groups ascend. A pair may come more than once."""
    na, nb = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    b_at = np.cumsum(nb) - nb
    wide = na * nb > _WIDE
    some = ~wide[a_group]
    a, g = a_ids[some], a_group[some]
    b = b_ids[_spread(b_at[g], nb[g])]
    out = [(np.repeat(g, nb[g]), np.repeat(a, nb[g]) << 32 | b, np.ones(len(b), dtype=np.int64))]
    a_at = np.cumsum(na) - na
    for k in np.flatnonzero(wide):
        (x, p), (y, q) = (np.unique(ids[at[k] : at[k] + m[k]], return_counts=True) for ids, at, m in ((a_ids, a_at, na), (b_ids, b_at, nb)))
        out.append((np.full(len(x) * len(y), k), (x[:, None] << 32 | y).ravel(), (p[:, None] * q).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Aligner:
    """Groups and links of texts, through a bounded cache of chunks.

    Neither tokenizer joins anything across a place where white space begins
    with a blank or a line end, so a text's tokens, groups and links are those
    of its chunks, which recur. Texts with other white space are one chunk. The
    cache has two halves, as a packer's.
    """

    def __init__(self, a_path: str, b_path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        self.by_chunk = all("\n" not in p and " " not in p.lstrip("▁").replace("▁", " ") for i, p in pieces if not self.b.is_byte(i))
        self.decimal = list(map(str, range(max(len(self.a_bytes), len(self.b_bytes)))))
        self.digits = np.array([len(x) for x in self.decimal], dtype=np.int64)
        self.half, self.young, self.old = most // 2, {}, {}

    def b_ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that begin with a blank, which B adds itself, or with a line end, before which B's blank goes."""
        found = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [[self.blank] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]

    def _joined(self, chunks: list[str], size: int = 256) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Chunks that are tokenized as parts of longer texts: which they are, and for each side the ids and their chunks, counted among these.

        Groups of chunks whose texts do not come back, or are not cut where
        chunks end, are left to be tokenized one by one, as are chunks that end
        in white space, which would grow together with the next one's.
        """
        fit = [k for k, c in enumerate(chunks) if c[-1] not in " \n\r\t" and c[0] in " \n"]
        groups = [fit[s : s + size] for s in range(0, len(fit), size)]
        texts = ["".join([chunks[k] for k in g]) for g in groups]
        sides = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b_ids(texts))
        done, ids, of = [], ([], []), ([], [])
        for j, (g, text) in enumerate(zip(groups, texts, strict=True)):
            raw, ends, own = text.encode(), np.cumsum([len(chunks[k].encode()) for k in g]), []
            for found, entry, lengths in zip(sides, (self.a_bytes, self.b_bytes), (self.a_len, self.b_len), strict=True):
                some = np.array(found[j], dtype=np.int64)
                to = np.cumsum(lengths[some])
                chunk = np.searchsorted(ends, to)
                if b"".join([entry[i] for i in found[j]]) == raw and (to[np.concatenate((chunk[1:] != chunk[:-1], [True]))] == ends).all():
                    own.append((some, chunk))
            if len(own) == 2:
                for side, (some, chunk) in enumerate(own):
                    ids[side].append(some)
                    of[side].append(chunk + len(done))
                done += g
        return done, ids, of

    def _each(self, chunks: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """The same, one by one: the chunks that both sides give back byte by byte."""
        sides = ([e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)], self.b_ids(chunks))
        done = [k for k, c in enumerate(chunks) if c and all(b"".join([entry[i] for i in ids[k]]) == c.encode() for ids, entry in zip(sides, (self.a_bytes, self.b_bytes), strict=True))]
        sizes = [[len(ids[k]) for k in done] for ids in sides]
        return done, [[np.array([i for k in done for i in ids[k]], dtype=np.int64)] for ids in sides], [[np.repeat(np.arange(len(done)), n)] for n in sizes]

    def learn(self, chunks: list[str]) -> list[tuple | None]:
        """What chunks have: groups as text, counts, distinct pairs and their times, these as bytes; None for chunks that a tokenizer doesn't give back."""
        out: list[tuple | None] = [None] * len(chunks)
        same, ids, of = self._joined(chunks)
        rest = sorted(set(range(len(chunks))).difference(same))
        more, more_ids, more_of = self._each([chunks[k] for k in rest])
        a, b = (np.concatenate([*x, *y]).astype(np.int64) for x, y in zip(ids, more_ids, strict=True))
        a_of, b_of = (np.concatenate([*x, *(z + len(same) for z in y)]).astype(np.int64) for x, y in zip(of, more_of, strict=True))
        same += [rest[k] for k in more]
        if not same:
            return out
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        side, of, ids = np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a_of, b_of)), np.concatenate((a, b))
        order, group = coalesce(np.concatenate((a_end - self.a_len[a], b_end - self.b_len[b])), np.concatenate((a_end, b_end)), side)
        n, where = int(group[-1]) + 1, np.empty(len(order), dtype=np.int64)
        where[order] = group
        a_group, b_group = where[: len(a)], where[len(a) :]
        of_group = np.empty(n, dtype=np.int64)
        of_group[where] = of  # a chunk's ends are both sides' ends, so no group lies in two
        links = np.bincount(a_group, minlength=n) * np.bincount(b_group, minlength=n)
        m = len(same)
        counts = np.stack([np.bincount(a_of, minlength=m), np.bincount(b_of, minlength=m), np.bincount(of_group, minlength=m), np.bincount(of_group, weights=links, minlength=m).astype(np.int64)], axis=1)

        at, pair, times = link_pairs(a, b, a_group, b_group, n)
        kinds, code = np.unique(pair, return_inverse=True)
        key, times = _sums(of_group[at] * len(kinds) + code, times)
        chunk, code = np.divmod(key, len(kinds))
        pairs, once = kinds[code].tobytes(), np.bincount(chunk, weights=times > 1, minlength=m) == 0
        cuts, times = (8 * np.searchsorted(chunk, np.arange(m + 1))).tolist(), times.tobytes()

        by_group = np.lexsort((side, where))  # ids as they are written: groups in order, A before B
        shown, last = ids[by_group], np.concatenate((where[by_group][1:] != where[by_group][:-1], [True]))
        turn = ~last & np.concatenate((side[by_group][1:] != side[by_group][:-1], [False]))
        marks = np.where(last, ";", np.where(turn, "|", ",")).tolist()
        text = "".join([x for pair in zip([self.decimal[i] for i in shown.tolist()], marks, strict=True) for x in pair])
        ends = np.cumsum(self.digits[shown] + 1)[np.searchsorted(of[by_group], np.arange(m), "right") - 1].tolist()
        start, counts = 0, counts.tolist()
        for j, (k, alone) in enumerate(zip(same, once.tolist(), strict=True)):
            out[k] = (text[start : ends[j] - 1], counts[j], pairs[cuts[j] : cuts[j + 1]], b"" if alone else times[cuts[j] : cuts[j + 1]])
            start = ends[j]
        return out

    def of_chunks(self, chunks: list[str]) -> list[tuple | None]:
        """What distinct chunks have."""
        got = [self.young.get(c, 0) for c in chunks]
        late = [k for k, x in enumerate(got) if x == 0]
        new = []
        for k in late:
            if (x := self.old.get(chunks[k], 0)) == 0:
                new.append(k)
            else:
                got[k] = x
        for s in range(0, len(new), 20_000):
            some = new[s : s + 20_000]
            for k, x in zip(some, self.learn([chunks[k] for k in some]), strict=True):
                got[k] = x
        short = [k for k in late if len(chunks[k]) <= 64]  # long chunks hardly recur
        if len(self.young) + len(short) > self.half:
            self.old, self.young = self.young, {}
        self.young.update((chunks[k], got[k]) for k in short)
        return got

    def block(self, texts: list) -> dict:
        """The columns of BLOCK, without ids, of some documents."""
        given = pa.array([f" {t}" if t else None for t in texts], pa.large_string())
        odd = pc.match_substring_regex(given, _ODD) if self.by_chunk else pc.is_valid(given)
        cut = pc.replace_substring_regex(pc.if_else(odd, "", given), "([^ \t\r\n])([ \n])", f"\\1{_CUT}\\2")
        parts = pc.split_pattern(cut, _CUT)
        coded = parts.values.dictionary_encode()
        chunks, codes, cuts = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64)
        got = [None if c == "" else x for c, x in zip(chunks, self.of_chunks([c or " " for c in chunks]), strict=True)]
        for k, o in enumerate(odd.to_pylist()):
            if o:  # such a text is one chunk, which stands where its cut would have
                codes[cuts[k]] = len(got)
                got += self.learn([f" {texts[k]}"])
        doc = np.repeat(np.arange(len(texts)), np.diff(cuts))
        lost = np.array([x is None for x in got], dtype=bool)
        given = np.array([bool(t) for t in texts], dtype=bool) & (np.bincount(doc, weights=lost[codes], minlength=len(texts)) == 0)
        own = given[doc]
        doc, codes = doc[own], codes[own]
        shown = ["" if x is None else x[0] for x in got]
        counts = np.array([(0, 0, 0, 0) if x is None else x[1] for x in got], dtype=np.int64).reshape(-1, 4)
        rows = np.stack([np.bincount(doc, weights=counts[codes, k], minlength=len(texts)) for k in range(4)]).astype(np.int64)
        ends, sha = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist(), [""] * len(texts)
        words = [shown[k] for k in codes.tolist()]
        for d, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
            if given[d]:
                sha[d] = hashlib.sha256(";".join(words[start:end]).encode()).hexdigest()

        sizes = np.array([0 if x is None else len(x[2]) // 8 for x in got], dtype=np.int64)
        pairs, of_chunk = np.unique(np.frombuffer(b"".join([x[2] for x in got if x]), dtype=np.int64), return_inverse=True)
        times = np.frombuffer(b"".join([x[3] or b"\1\0\0\0\0\0\0\0" * (len(x[2]) // 8) for x in got if x]), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        key, n = _sums(doc * len(got) + codes, np.ones(len(doc), dtype=np.int64))
        d, c = np.divmod(key, max(1, len(got)))
        at = _spread(starts[c], sizes[c])
        key, n = _sums(np.repeat(d, sizes[c]) * len(pairs) + of_chunk[at], np.repeat(n, sizes[c]) * times[at])
        d, p = np.divmod(key, max(1, len(pairs)))
        held = np.bincount(p, minlength=len(pairs))
        used = np.flatnonzero(held)  # pairs of chunks that stand only in texts without tokens are in no document
        step = np.diff((np.cumsum(held > 0) - 1)[p], prepend=0)
        return {name: rows[k].tolist() for k, name in enumerate(COUNTS)} | {
            "groups_sha256": sha, "sizes": np.bincount(d, minlength=len(texts)).tolist(), "places": packed(step), "times": packed(n), "pairs": pairs[used], "held": held[used],
        }


def packed(numbers: np.ndarray) -> bytes:
    """Small whole numbers as compressed bytes, after their count."""
    wide = "<i4" if not len(numbers) or -(1 << 31) <= numbers.min() and numbers.max() < 1 << 31 else "<i8"
    raw = numbers.astype(wide).tobytes()
    return f"{wide}{len(numbers):012d}".encode() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    wide, n = blob[:3].decode(), int(blob[3:15])
    return np.frombuffer(pa.decompress(blob[15:], n * int(wide[2]), codec="zstd", asbytes=True), dtype=wide).astype(np.int64)


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, block_chars: int = 4_000_000, work: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A sees a blank and the text, B the text, to which it adds the blank. Tokens
    stand on byte ranges; ranges that overlap, directly or through others, are
    a group, and every token of A in a group is linked to every one of B. A
    pair of ids counts the documents that hold it linked. ``n_best`` counts the
    links whose pair has the highest count of its A id (ties included),
    ``count_sum`` sums the counts over links.

    Texts that are null, empty, or that a tokenizer doesn't give back byte by
    byte, have zeros and an empty digest. Repeated rows, and rows with equal or
    null ids, are documents of their own. An empty table gives an empty one.
    Other columns are left out. A text of any length is read whole; one task
    holds a block of about ``block_chars`` characters, or one longer text.

    Documents are encoded once, block by block. Only a block's distinct pairs
    leave it, so counting and looking up move a row for each pair and block,
    not for each link; a pair that every document holds is one row a block.
    The highest count of an A id is broadcast: at most one row an id.
    """
    a_path, b_path = a_path or default_tokenizers()[0], b_path or default_tokenizers()[1]
    docs, work = pick(df, doc_id=id_col, text=text_col), work or Scratch(df.sparkSession)
    short_batches(df.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(BLOCK.format(id=kind))
    fields = to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept(f"align {a_path} {b_path}", lambda: Aligner(a_path, b_path))
        at = TaskContext.get().partitionId() << 32
        for ids, texts in gathered(batches, block_chars):
            row = {"block": at, "doc_ids": ids} | aligner.block(texts)
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in fields], schema=fields)
            at += 1
        pa.default_memory_pool().release_unused()

    blocks = work.save(docs.mapInArrow(encode, schema), "blocks")
    links = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held"))).select("block", F.col("pos").alias("place"), F.col("col.pairs").alias("pair"), F.col("col.held").alias("held"))
    counts = work.save(links.groupBy("pair").agg(F.sum("held").alias("count")).withColumn("a", F.shiftright("pair", 32)), "counts")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    found = links.join(counts.hint("merge"), "pair").select(F.col("block").alias("of"), "place", "count", "best")
    out = T._parse_datatype_string(ALIGNED.format(id=kind))
    out_fields = to_arrow_schema(out)

    def look_up(block: pa.Table, counted: pa.Table) -> pa.Table:
        columns: dict[str, list] = {f.name: [] for f in out_fields}
        for row in block.to_pylist():
            count = np.zeros((2, counted.num_rows), dtype=np.int64)
            place = counted["place"].to_numpy()
            count[0][place], count[1][place] = counted["count"].to_numpy(), counted["best"].to_numpy()
            sizes = np.array(row["sizes"], dtype=np.int64)
            places, times = np.cumsum(unpacked(row["places"])), unpacked(row["times"])
            sums = np.concatenate((np.zeros((2, 1), dtype=np.int64), np.cumsum(count[:, places] * times, axis=1)), axis=1)
            ends = np.cumsum(sizes)
            n_sum, n_best = (sums[:, ends] - sums[:, ends - sizes]).tolist()
            columns["doc_id"] += row["doc_ids"]
            columns["count_sum"] += n_sum
            columns["n_best"] += n_best
            for name in (*COUNTS, "groups_sha256"):
                columns[name] += row[name]
        return pa.Table.from_arrays([pa.array(columns[f.name], type=f.type) for f in out_fields], schema=out_fields)

    return blocks.drop("pairs", "held").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(look_up, out)
