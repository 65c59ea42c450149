"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import pick, sampled, spans_text, with_columns

# The patterns of the contract, least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: Tokens are scored whole, and otherwise by their parts between = and /, which join names and paths to values.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9+_-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{6,}")
#: Alphabets of usual keys; each makes a kind of random string besides those of the labelled values.
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
START = len(SYMBOLS)
CODES = np.full(128, START, dtype=np.int64)
CODES[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by start, then kind as listed.

    A run of hexadecimal digits, or of capitals and digits after AKIA, is
    matched whole or not at all, so its least length can stand in the pattern;
    an assignment's cannot, since a short value still uses up its text.
    """
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _pairs(*tokens: str) -> np.ndarray:
    """Index of each pair of neighbouring characters of the tokens, the first of each after a start mark."""
    codes = CODES[np.frombuffer("\n".join(("", *tokens)).encode("ascii"), dtype=np.uint8)]
    return (codes[:-1] * (START + 1) + codes[1:])[codes[1:] < START]


def _uncovered(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What the taken spans (by start) leave of a text."""
    at = 0
    for _, a, b in taken:
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(text):
        yield at, len(text)


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio of each character pair, random against ordinary, for each kind of random string; None: no labelled samples.

    A token's ratio is that of the kind that fits it best. It is a secret at
    ``least_total`` in all and ``least_mean`` a character.
    """

    ratio: np.ndarray | None
    least_total: float = 24.0
    least_mean: float = 1.7

    def score(self, token: str) -> float:
        return 0.0 if self.ratio is None else float(self.ratio[:, _pairs(token)].sum(axis=1).max())

    def random(self, token: str) -> bool:
        s = self.score(token)
        return s >= self.least_total and s >= self.least_mean * len(token)

    def spans(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Random tokens in what the taken spans, by start, leave of the text; one walk, so linear in both."""
        if self.ratio is None:
            return []
        found = []
        for a, b in _uncovered(text, taken):
            for m in CANDIDATE.finditer(text, a, b):
                if self.random(m[0]):
                    found.append(("markov", *m.span()))
                elif "=" in m[0] or "/" in m[0]:
                    found += [("markov", *p.span()) for p in PART.finditer(text, *m.span()) if self.random(p[0])]
        return found


def _joined(words: list[str]) -> list[str]:
    """Names as programs have them, made of neighbouring words: labelled ordinary, since prose holds few."""
    out = []
    for k, (a, b) in enumerate(zip(words[::2], words[1::2], strict=False)):
        n = zlib.crc32(a.encode())
        out.append((f"{a}_{b}", a.capitalize() + b.capitalize(), f"{a}-{b}{n % 100}", f"{a}_{2000 + n % 30}-{1 + n % 12:02d}-{1 + n % 28:02d}", f"{a}_{b}_{n % 10}".upper(), f"/{a}/{b}/{n % 1000}", f"{a}={b}+{n % 10}")[k % 7])
    return out


def fit_markov(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, smoothing: float = 0.5, weight: float = 5.0) -> MarkovPair:
    """The models from labelled samples in about ``sample_docs`` documents.

    Labelled random: values that the base patterns find. Labelled ordinary:
    identifiers of six characters and more outside those, and names joined of
    neighbouring ones. The pair counts are summed by Spark; at most 2 x 69 x 69
    sums reach the driver. Keys of an alphabet of which the documents hold no
    sample have that alphabet's even pairs as model. If either label has no
    sample, the pair gives no spans.
    """
    docs = sampled(pick(df, doc_id=id_col, text=text_col).where("text is not null"), "doc_id", sample_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = (START + 1) ** 2
        sums = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                spans = base_spans(text)
                values = [ASSIGN.match(text, a, b)[2] if kind == "assign" else text[a:b] for kind, a, b in spans]
                names = [m[0] for a, b in _uncovered(text, spans) for m in IDENTIFIER.finditer(text, a, b)]
                names += _joined([t for t in names if t.isalpha()])
                for k, tokens in enumerate((names, values)):
                    if tokens:
                        sums[k] += np.bincount(_pairs(*tokens), minlength=size)
        label, pair = np.nonzero(sums)
        yield pd.DataFrame({"label": label, "pair": pair, "n": sums[label, pair]})

    sums = docs.select("text").mapInPandas(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, START + 1, START + 1))
    for label, pair, n in sums:
        counts[label].flat[pair] = n
    if not counts[0].any() or not counts[1].any():
        return MarkovPair(None)
    # Each row is drawn to its label's character frequencies, which also stand for rows without samples.
    single = counts.sum(axis=1)[:, None, :] + smoothing
    counts += weight * single / single.sum(axis=2, keepdims=True)
    ordinary, labelled = counts / counts.sum(axis=2, keepdims=True)
    kinds = [labelled]
    for alphabet in ALPHABETS:
        even = np.full((START + 1, START + 1), 1e-6)
        even[:, CODES[[ord(c) for c in alphabet]]] = 1.0
        kinds.append(even / even.sum(axis=1, keepdims=True))
    return MarkovPair(np.log(np.stack(kinds) / ordinary).reshape(len(kinds), -1))


def find_secrets(df: DataFrame, text_col: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """df with base and spans: what the patterns find, and that with what the Markov models add.

    Spans are (kind, start, end) in code points, end exclusive, by start and
    then kind. Added spans have kind ``markov`` and overlap no base span. A
    null or empty text has no spans; repeated rows and null ids keep a row
    each; an empty table gives an empty one. Whole texts are read, one at a
    time. Columns named base or spans are replaced, all others pass.
    """
    pair = model or MarkovPair(None)

    def start():
        def scan(texts: list) -> list[list]:
            base = [base_spans(t) if t else [] for t in texts]
            more = [sorted(b + pair.spans(t, b), key=lambda s: (s[1], KINDS.index(s[0]))) if t else [] for t, b in zip(texts, base, strict=True)]
            return [[[{"kind": x, "start": s, "end": e} for x, s, e in v] for v in lists] for lists in (base, more)]

        return scan

    return with_columns(df, text_col, start, f"base {SPANS}, spans {SPANS}")


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    if not text or not len(spans):
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact_documents(df: DataFrame, text_col: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """df with clean_text and n_secrets: the text with its spans replaced, and how many there were; nulls and empties as in find_secrets()."""
    pair = model or MarkovPair(None)

    def clean(text: str | None) -> tuple[str | None, int]:
        base = base_spans(text) if text else []
        found = base + pair.spans(text, base) if text else []
        return redact(text, [{"start": a, "end": b} for _, a, b in found]), len(found)

    return with_columns(df, text_col, lambda: lambda texts: [list(c) for c in zip(*map(clean, texts), strict=True)] or [[], []], "clean_text string, n_secrets long")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
