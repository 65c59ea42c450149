"""Language ID: unigram pieces of a fixed public vocabulary, summed over all segmentations of each word."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import Scratch, kept, pick, short_batches, text_chunks, with_columns

#: Runs of word characters; those of them that are no letters (numbers such as ½ and Ⅷ) end a word.
RUN = re.compile(r"[^\W\d_]+")
MARK = "▁"
_BASE, _MULT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(64 - 21)
#: Words up to this length are scored many at once without scaling, since no product of so many chances gets too small; longer ones with it.
SHORT = 40
FLOOR = 1e-7
#: Languages whose sums are held at once, and numbers that a worker keeps of words that it has scored.
LANGS_AT_ONCE, KEPT = 32, 4_000_000


def letter_words(text: str) -> list[str]:
    """The runs of letters (Unicode's category L) of a text."""
    out = []
    for run in RUN.findall(text):
        out += [run] if run.isalpha() else "".join([c if c.isalpha() else " " for c in run]).split()
    return out


def public_pieces(path: str | None = None) -> list[str]:
    """The lower-case letter pieces of a sentencepiece vocabulary file."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if re.fullmatch(rf"{MARK}?[^\W\d_]+|{MARK}", p))


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), dtype=np.uint64)
    for j in range(codes.shape[1]):
        h = h * _BASE + codes[:, j]
    return h


class Vocabulary:
    """Looks up many substrings at once by a 64-bit hash."""

    def __init__(self, pieces: list[str]):
        h = np.array([_hash(_codes([p]))[0] for p in pieces], dtype=np.uint64)
        order = np.argsort(h)
        self.hashes, self.place, self.longest, self.size = h[order], order.astype(np.int32), max(map(len, pieces)), len(pieces)
        self.maybe = np.zeros(1 << 21, dtype=bool)
        self.maybe[((h * _MULT) >> _BITS).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of h that are pieces, and which."""
        rows = np.flatnonzero(self.maybe[((h * _MULT) >> _BITS).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[rows]), self.size - 1)
        good = self.hashes[at] == h[rows]
        return rows[good], self.place[at[good]]


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)


def _edges(vocabulary: Vocabulary, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, rows, pieces) for words of one length, by end and then start; piece -1: one character outside the vocabulary."""
    codes = _codes(words)
    n = codes.shape[1]
    found: list[list] = [[] for _ in range(n + 1)]
    for i in range(n):
        h = np.zeros(len(words), dtype=np.uint64)
        for j in range(i + 1, min(n, i + vocabulary.longest) + 1):
            h = h * _BASE + codes[:, j - 1]
            rows, pieces = vocabulary.find(h)
            if j == i + 1 and len(rows) < len(words):
                lone = np.setdiff1d(np.arange(len(words)), rows, assume_unique=True)
                rows, pieces = np.concatenate((rows, lone)), np.concatenate((pieces, np.full(len(lone), -1, np.int32)))
            if len(rows):
                found[j].append((i, rows, pieces))
    for j in range(1, n + 1):
        for i, rows, pieces in found[j]:
            yield i, j, rows, pieces


#: Letters that training reads as one word at most; longer runs are read there in parts, of which only the first begins a word.
TRAINED = 1_000


def _parts(word: str) -> list[str]:
    """A word for training, in parts of TRAINED letters."""
    return [(MARK if k == 0 else "") + word[k : k + TRAINED] for k in range(0, len(word), TRAINED)]


def expected_uses(edges: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, rows: int, chance_of) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, pieces, expected uses) of each edge over all segmentations of words of n letters, edges by end and then start.

    Sums up to each letter are kept relative to the one before, so no product
    gets too small; what they are relative to is kept as a logarithm.
    """
    ahead, low = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
    ahead[0] = 1.0
    for j, group in groupby(edges, key=lambda e: e[1]):
        for i, _, r, p in group:
            ahead[j, r] += ahead[i, r] * np.exp(low[i, r] - low[j - 1, r]) * chance_of(r, p)
        low[j] = low[j - 1] + np.log(ahead[j])
        ahead[j] = 1.0
    back, high = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
    back[n] = 1.0
    for i, group in groupby(sorted(edges, key=lambda e: -e[0]), key=lambda e: e[0]):
        for _, j, r, p in group:
            back[i, r] += back[j, r] * np.exp(high[j, r] - high[i + 1, r]) * chance_of(r, p)
        high[i] = high[i + 1] + np.log(back[i])
        back[i] = 1.0
    for i, j, r, p in edges:
        yield r, p, np.exp(low[i, r] + high[j, r] - low[n, r]) * chance_of(r, p)


class Model:
    """Piece probabilities of each language; the last row is for a character outside the vocabulary."""

    def __init__(self, langs: list[str], vocabulary: Vocabulary, chance: np.ndarray):
        self.langs, self.vocabulary, self.chance, self.key = langs, vocabulary, chance, uuid.uuid4().hex

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """words x languages: log of the sum over all segmentations of each whole word."""
        out = np.zeros((len(words), len(self.langs)))
        for n, rows, parts in _by_length([(k, MARK + w) for k, w in enumerate(words) if len(w) <= SHORT]):
            edges = list(_edges(self.vocabulary, parts))
            for a in range(0, len(self.langs), LANGS_AT_ONCE):
                chance = self.chance[:, a : a + LANGS_AT_ONCE]
                forward = np.zeros((n + 1, len(parts), chance.shape[1]))
                forward[0] = 1.0
                for i, j, at, pieces in edges:
                    forward[j, at] += forward[i, at] * chance[pieces]
                out[rows, a : a + LANGS_AT_ONCE] = np.log(np.maximum(forward[n], 1e-300))
        long = sorted((k for k, w in enumerate(words) if len(w) > SHORT), key=lambda k: -len(words[k]))
        while long:  # of similar length together, half a million characters at most unless one word has more
            most = max(1, 500_000 // (len(words[long[0]]) + 1))
            out[long[:most]] = self._scaled([MARK + words[k] for k in long[:most]])
            long = long[most:]
        return out

    def _scaled(self, words: list[str], at_once: int = 500_000, every: int = 8) -> np.ndarray:
        """log_likelihood() of long words, longest first: only the columns that a piece can reach are held, and scaled as they go."""
        sizes = np.array([len(w) for w in words])
        n, reach = int(sizes[0]), self.vocabulary.longest
        codes = np.zeros((len(words), n + reach), dtype=np.uint64)
        for k, w in enumerate(words):
            codes[k, : len(w)] = _codes([w])[0]
        ring, logs, out = np.zeros((reach + 1, len(words), len(self.langs))), 0.0, np.empty((len(words), len(self.langs)))
        ring[0] = 1.0
        for first in range(0, n, step := max(1, at_once // len(words))):
            last = min(n, first + step)
            h, found = np.zeros((len(words), last - first), dtype=np.uint64), []
            for size in range(1, reach + 1):
                h = h * _BASE + codes[:, first + size - 1 : last + size - 1]
                flat, pieces = self.vocabulary.find(h.ravel())
                if size == 1:
                    lone = np.ones(h.size, dtype=bool)
                    lone[flat] = False
                    flat, pieces = np.concatenate((flat, np.flatnonzero(lone))), np.concatenate((pieces, np.full(int(lone.sum()), -1, np.int32)))
                row, at = np.divmod(flat, last - first)
                inside = first + at + size <= sizes[row]
                found.append(np.stack((at[inside], row[inside], np.full(int(inside.sum()), size), pieces[inside])))
            edges = np.concatenate(found, axis=1)
            edges = edges[:, np.argsort(edges[0], kind="stable")]
            cut = np.searchsorted(edges[0], np.arange(last - first + 1)).tolist()
            for i in range(first, last):
                _, row, size, piece = edges[:, cut[i - first] : cut[i - first + 1]]
                now = ring[i % (reach + 1)]
                ring[(i + size) % (reach + 1), row] += now[row] * self.chance[piece]
                now[:] = 0.0
                done = np.flatnonzero(sizes == i + 1) if i + 1 >= sizes[-1] else ()
                if len(done):
                    out[done] = np.log(np.maximum(ring[(i + 1) % (reach + 1), done], 1e-300)) + (logs[done] if i >= every else 0.0)
                if i % every == every - 1:
                    top = ring.max(axis=0)
                    top[top == 0] = 1.0
                    ring /= top
                    logs = logs + np.log(top)
        return out


def _by_length(parts: list[tuple[int, str]], most: int = 20_000) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Parts of one length at a time, few enough to hold all their prefixes."""
    groups: dict[int, list] = {}
    for k, p in parts:
        groups.setdefault(len(p), []).append((k, p))
    for n, group in sorted(groups.items()):
        for a in range(0, len(group), most):
            chunk = group[a : a + most]
            yield n, np.array([k for k, _ in chunk]), [p for _, p in chunk]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _by_lang(docs: DataFrame, sample_docs: int) -> DataFrame:
    """About ``sample_docs`` documents in equal shares of the languages, chosen by a hash of the id; of a rare one, all."""
    sizes = docs.groupBy("lang").count().collect()
    if not sizes:
        return docs.limit(0)
    share, slots = max(1, sample_docs // len(sizes)), 1 << 20
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(1, int(slots * min(1.0, share / r["count"]))))])
    return docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(17)), F.lit(slots)) < F.coalesce(rates[F.col("lang")], F.lit(0)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary_path: str | None = None, sample_docs: int = 6_000, rounds: int = 2, work: Scratch | None = None) -> Model | None:
    """Expectation maximisation over about ``sample_docs`` labelled documents that are not held out.

    Every language has an equal share of the sample, one document at least, so
    a rare one is learned at any size. A table of languages x vocabulary goes
    to every executor: 160 KB for each value that ``lang_col`` has.
    The words of the sample are counted by language once and written; each
    round sums the expected uses of every piece over them in Spark, from which
    languages x vocabulary sums reach the driver. None: nothing to learn from.
    """
    docs = pick(df, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    vocabulary = Vocabulary(pieces := public_pieces(vocabulary_path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                for w in letter_words(text.lower()):
                    sums[lang, w] = sums.get((lang, w), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in sums.items()], columns=["lang", "word", "n"])

    work = work or Scratch(df.sparkSession)
    short_batches(df.sparkSession)
    words = work.save(_by_lang(docs, sample_docs).select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not langs:
        return None
    at = {lang: k for k, lang in enumerate(langs)}
    model = Model(langs, vocabulary, np.ones((len(pieces) + 1, 1)) / len(pieces))
    for step in range(rounds + 1):
        shared = df.sparkSession.sparkContext.broadcast((vocabulary, model.chance))

        def expect(batches: Iterator[pd.DataFrame], shared=shared, step=step) -> Iterator[pd.DataFrame]:
            vocabulary, chance = shared.value
            sums = np.zeros((len(langs), len(chance)))
            for batch in batches:
                lang, weight = batch["lang"].map(at).to_numpy(), batch["n"].to_numpy(dtype=float)
                for n, rows, parts in _by_length([(k, p) for k, w in enumerate(batch["word"]) for p in _parts(w)]):
                    edges, own, heavy = list(_edges(vocabulary, parts)), lang[rows], weight[rows]
                    if step == 0:  # at first, every occurrence of a piece counts
                        for _, _, r, p in edges:
                            np.add.at(sums, (own[r], p), heavy[r])
                        continue
                    for r, p, uses in expected_uses(edges, n, len(parts), lambda r, p, own=own: chance[p, own[r]]):
                        np.add.at(sums, (own[r], p), uses * heavy[r])
            lang, piece = np.nonzero(sums)
            yield pd.DataFrame({"lang": lang, "piece": piece, "n": sums[lang, piece]})

        found = words.mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros((len(pieces) + 1, len(langs)))
        sums[found["piece"], found["lang"]] = found["n"]
        sums[-1] = 0
        chance = sums / np.maximum(sums.sum(axis=0), 1.0)
        chance = 0.999 * chance + 0.001 / len(pieces)
        chance[-1] = FLOOR
        model = Model(langs, vocabulary, chance)
        shared.unpersist()
    work.drop(words)
    return model


class _Scores:
    """Log-likelihoods of words, kept between batches up to a bound."""

    def __init__(self, model: Model, most: int = 250_000):
        self.model, self.most, self.row = model, min(most, KEPT // max(1, len(model.langs)) + 1), {}
        self.table = np.zeros((1024, len(model.langs)), dtype=np.float64)

    def add(self, lists: list[list[str]]) -> None:
        new = {w for words in lists for w in words} - self.row.keys()
        if len(self.row) + len(new) > self.most:
            self.row, self.table, new = {}, self.table[:1024], {w for words in lists for w in words}
        if not new:
            return
        new = sorted(new)
        a, b = len(self.row), len(self.row) + len(new)
        if b > len(self.table):
            self.table = np.concatenate((self.table[:a], np.zeros((2 * b - a, self.table.shape[1]))))
        self.table[a:b] = self.model.log_likelihood(new)
        self.row.update(zip(new, range(a, b), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        return self.table[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)


def identify(df: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """df with lang_pred and score.

    Each word of the whole text is scored under each language by the forward
    algorithm; the sum over words gives the posterior with equal priors, of
    which the largest is the score. Equal posteriors go to the language that
    sorts first. A null text, one without letters, and every text when nothing
    could be learned get ``und`` with score 0. Repeated rows and null ids keep
    a row each; an empty table gives an empty one. Columns named lang_pred or
    score are replaced, all others pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x vocabulary numbers

    def start():
        model = shared.value
        scores = kept(model.key, lambda: _Scores(model)) if model is not None else None

        def run(texts: list) -> list[list]:
            if scores is None:
                return [["und"] * len(texts), [0.0] * len(texts)]
            preds, sure = [], []
            for chunk in text_chunks(texts):
                lists = [letter_words(t.lower()) if t else [] for t in chunk]
                scores.add(lists)
                for words in lists:
                    if not words:
                        preds.append("und")
                        sure.append(0.0)
                        continue
                    total = scores.total(words)
                    k = int(total.argmax())
                    preds.append(model.langs[k])
                    sure.append(float(1 / np.exp(total - total[k]).sum()))
            return [preds, sure]

        return run

    return with_columns(df, text_col, start, "lang_pred string, score double")
