"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import pick, sampled, spans_text, with_columns

# Kinds in the contract's order and its patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check that a match of a kind must pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))
    d = digits(text) if kind != "email" else ""
    return {"email": True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the whole pattern would match, found from each @ so that long runs of letters cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


# Characters that the network tells apart: a digit, a capital, each lower-case letter and ASCII mark, white space, all else.
_CODES = np.full(128, 1, dtype=np.uint8)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CODES[ord(_c)] = 5 + _k
_CODES[ord("0") : ord("9") + 1], _CODES[ord("A") : ord("Z") + 1], _CODES[[9, 10, 13, 32]] = 2, 3, 4
N_CODES = int(_CODES.max()) + 1
TAGS = len(KINDS) + 1


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], np.uint8(1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding, one LSTM each way, tag scores, CRF transitions."""

    def __init__(self, hidden: int = 16, size: int = 10, seed: int = 3):
        rng, self.hidden = np.random.default_rng(seed), hidden
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"E": draw(N_CODES, size), "T": np.zeros((TAGS, TAGS), np.float32), "O": draw(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(size, 4 * hidden), f"U{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1.0

    def _lstm(self, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: time x batch x size. Outputs of one direction, in time order."""
        h = self.hidden
        z, out = x @ self.p[f"W{d}"] + self.p[f"c{d}"], np.empty((*x.shape[:2], h), np.float32)
        hid = cell = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = z[t] + hid @ self.p[f"U{d}"]
            gates, new = _sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])
            before, past = cell, hid
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            shown = np.tanh(cell)
            hid = out[t] = gates[:, 2 * h :] * shown
            if keep is not None:
                keep.append((t, gates, new, before, past, shown))
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """codes: batch x time. Tag scores, time x batch x tags."""
        x = self.p["E"][codes.T]
        return np.concatenate((self._lstm("f", x), self._lstm("b", x)), axis=2) @ self.p["O"] + self.p["o"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tag path of each row, by the CRF."""
        s, move = self.scores(codes), self.p["T"]
        best, back = s[0], np.empty((len(s), s.shape[1], TAGS), np.int8)
        for t in range(1, len(s)):
            step = best[:, :, None] + move
            back[t] = step.argmax(axis=1)
            best = step.max(axis=1) + s[t]
        path = np.empty((len(codes), len(s)), np.int8)
        path[:, -1] = best.argmax(axis=1)
        for t in range(len(s) - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(len(codes)), path[:, t]]
        return path

    def train(self, codes: np.ndarray, tags: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.015, seed: int = 5) -> None:
        """Adam on the CRF's log-likelihood."""
        rng, m, v, n = np.random.default_rng(seed), {}, {}, 0
        while n < steps:
            order = rng.permutation(len(codes))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                grad, n = self._gradient(codes[rows], tags[rows]), n + 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (1.05 - min(1.0, n / steps)) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)

    def _gradient(self, codes: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        x, kept, rows = self.p["E"][codes.T], {"f": [], "b": []}, np.arange(len(codes))
        both = np.concatenate([self._lstm(d, x, kept[d]) for d in "fb"], axis=2)
        s, move, y, n = both @ self.p["O"] + self.p["o"], self.p["T"], tags.T, len(codes)
        total = lambda a, axis: (top := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))
        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[0] = s[0]
        for t in range(1, len(s)):
            ahead[t] = total(ahead[t - 1][:, :, None] + move, 1) + s[t]
        for t in range(len(s) - 2, -1, -1):
            behind[t] = total(move + (s[t + 1] + behind[t + 1])[:, None, :], 2)
        norm = total(ahead[-1], 1)
        ds = np.exp(ahead + behind - norm[:, None])
        dmove = np.zeros_like(move)
        for t in range(1, len(s)):
            dmove += np.exp(ahead[t - 1][:, :, None] + move + (s[t] + behind[t])[:, None, :] - norm[:, None, None]).sum(axis=0)
            np.subtract.at(dmove, (y[t - 1], y[t]), 1)
        for t in range(len(s)):
            ds[t][rows, y[t]] -= 1
        ds /= n
        grad = {"T": dmove / n, "O": np.tensordot(both, ds, ((0, 1), (0, 1))), "o": ds.sum(axis=(0, 1))}
        dboth, h, dx = ds @ self.p["O"].T, self.hidden, np.zeros_like(x)
        for k, d in enumerate("fb"):
            dw, du, dc = (np.zeros_like(self.p[f"{w}{d}"]) for w in "WUc")
            dh = dcell = np.zeros((n, h), np.float32)
            for t, gates, new, before, past, shown in reversed(kept[d]):
                dh = dh + dboth[t][:, k * h : (k + 1) * h]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dcell = dcell + dh * o * (1 - shown * shown)
                da = np.concatenate((dcell * new * i * (1 - i), dcell * before * f * (1 - f), dh * shown * o * (1 - o), dcell * i * (1 - new * new)), axis=1)
                dw += x[t].T @ da
                du += past.T @ da
                dc += da.sum(axis=0)
                dx[t] += da @ self.p[f"W{d}"].T
                dh, dcell = da @ self.p[f"U{d}"].T, dcell * f
            grad |= {f"W{d}": dw, f"U{d}": du, f"c{d}": dc}
        grad["E"] = np.zeros_like(self.p["E"])
        np.add.at(grad["E"], codes.T, dx)
        return grad


WIDTH, STRIDE = 64, 32
DIGIT, AT = 2, int(_CODES[ord("@")])
#: How deep inside its window each place lies; at a text's start and end nothing is deeper.
_DEPTH = np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH)).astype(np.uint8) + 1


def _windows(codes: np.ndarray) -> np.ndarray:
    """Starts of the overlapping windows that hold a digit or an @, as every kind does."""
    cells = np.flatnonzero(np.bincount(np.flatnonzero((codes == DIGIT) | (codes == AT)) // STRIDE))
    return STRIDE * np.unique(np.concatenate((cells, np.maximum(cells - 1, 0)))) if len(cells) else cells


def _padded(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WIDTH, 4, dtype=np.uint8)
    part = codes[start : start + WIDTH]
    out[: len(part)] = part
    return out


def _reconciled(tags: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A tag for each of a text's n characters: that of the window in which it lies deepest, of equals the earlier; 0 outside."""
    out, deep = np.zeros(n, np.int8), np.zeros(n, np.uint8)
    for row, w in zip(tags, starts.tolist(), strict=True):
        m = min(WIDTH, n - w)
        depth = _DEPTH[:m]
        if w == 0:
            depth = np.where(np.arange(m) < WIDTH // 2, _DEPTH.max(), depth)
        better = depth > deep[w : w + m]
        out[w : w + m][better], deep[w : w + m][better] = row[:m][better], depth[better]
    return out


def tag_runs(tags: np.ndarray) -> list[Span]:
    """Runs of one tag as spans, in order."""
    cut = np.flatnonzero(np.diff(tags)) + 1
    edges = [0, *cut.tolist(), len(tags)]
    return [(KINDS[tags[a] - 1], a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b and tags[a]]


def predicted(tagger: Tagger, texts: list[str], at_once: int = 512) -> Iterator[tuple[np.ndarray, list[Span]]]:
    """Codes and spans of each text, in order.

    A text is encoded once. Windows of neighbouring texts are decoded together
    up to ``at_once``, those of a long text in several turns; what is held is a
    byte or two a character of the texts at hand.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> Iterator[tuple[np.ndarray, list[Span]]]:
        flat = [(codes, w) for codes, starts in held for w in starts.tolist()]
        tags = [tagger.decode(np.stack([_padded(c, w) for c, w in flat[a : a + at_once]])) for a in range(0, len(flat), at_once)]
        tags, at = np.concatenate(tags) if tags else np.empty((0, WIDTH), np.int8), 0
        for codes, starts in held:
            yield codes, tag_runs(_reconciled(tags[at : at + len(starts)], starts, len(codes))) if len(starts) else []
            at += len(starts)

    for text in texts:
        codes = encode(text)
        held.append((codes, _windows(codes)))
        n += len(held[-1][1])
        if n >= at_once:
            yield from flush()
            held, n = [], 0
    yield from flush()


def _shaped(kind: str, part: str) -> bool:
    if kind == "email":
        return "@" in part and "." in part.partition("@")[2] and not re.search(r"\s", part)
    if kind == "ip":
        return bool(IP.fullmatch(part))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9 .-]+", part))
    return bool(re.fullmatch(r"[+(]?[0-9][0-9() ./-]+[0-9]", part)) and bool(re.search("[(). /-]", part))


def _added(text: str, codes: np.ndarray, base: list[Span], found: list[Span]) -> list[Span]:
    """Predicted spans, trimmed and with no run of digits cut, that overlap no base span and no other, and pass their kind's check.

    All walks go from left to right and no run of digits is crossed twice, so
    the time is linear in the text.
    """
    if not found:
        return []
    digit = codes == DIGIT
    edge = np.flatnonzero(np.diff(np.concatenate(([False], digit, [False]))))
    begins, ends = edge[::2], edge[1::2]
    taken = sorted((a, b) for _, a, b in base)
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0, np.int64)
    firsts = [a for a, _ in taken]
    out, last = [], 0
    for kind, a, b in found:
        a = max(a, last)
        while a < b and text[a].isspace():
            a += 1
        if a < b and digit[a]:
            a = max(last, int(begins[np.searchsorted(begins, a, "right") - 1]))
        if a < b and digit[b - 1]:
            b = int(ends[np.searchsorted(ends, b - 1, "right")])
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        if a >= b:
            continue
        k = bisect_left(firsts, b)  # base spans that start before the end
        if (k and reach[k - 1] > a) or b - a > LONGEST:
            continue
        part = text[a:b]
        if _shaped(kind, part) and valid(kind, part):
            out.append((kind, a, b))
            last = b
    return out


#: No kind that the checks let pass is longer (addresses are 254 at most by their standard).
LONGEST = 320


def _variants(rng: random.Random, text: str, tags: list[int]) -> Iterator[tuple[str, list[int]]]:
    """A labelled window in other forms: numbers as the patterns do not have them, and harmless ones in their place."""
    tag = next((t for t in tags if t), 0)
    if not tag:
        return
    a = tags.index(tag)
    b = next((i for i in range(a, len(tags)) if tags[i] != tag), len(tags))
    number = lambda form: "".join(str(rng.randint(0, 9)) if c == "9" else str(rng.randint(2, 9)) if c == "2" else c for c in form)
    for kind, forms in (("phone", PHONES), ("card", CARDS), (None, HARMLESS)):
        new = number(rng.choice(forms))
        if kind == "card":
            head = digits(new)[:-1]
            check = next(c for c in "0123456789" if luhn(head + c))
            new = new[:-1] + check
        k = KINDS.index(kind) + 1 if kind else 0
        yield (text[:a] + new + text[b:])[:WIDTH], ([*tags[:a], *([k] * len(new)), *tags[b:]])[:WIDTH]


# Forms of numbers, 9 being any digit and 2 any from 2 on; the last list is of harmless ones.
PHONES = ("(299) 299-9999", "299-299-9999", "299.299.9999", "299 299 9999", "1-299-299-9999", "029 9999 9999", "0299/999999", "02 99 99 99 99")
CARDS = ("2999.9999.9999.9999", "2999-9999-9999-9999", "2999 9999 9999 9999", "2999.999999.99999")
HARMLESS = ("2022-09-29", "29.09.2022", "09:29:29", "2,999,999", "29.99", "2999", "No. 299999", "29-39", "2022/09/29 19:29", "v2.9.9", "299 of 999", "2-9999", "ISBN 979-2-99-999999-9", "#29999999", "2999-2999", "29 999 999", "2022-09-29 09:29:29", "979-2-99-999999-9", "2.9999 9.9999")


def fit_tagger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 20_000, most_windows: int = 2_000) -> Tagger | None:
    """Trained on at most 4 x ``most_windows`` windows from about ``sample_docs`` documents, labelled by the base patterns.

    Every window with a span is also given with a phone number and a card in
    forms that the patterns do not have, labelled, and with a date, price or
    other number that is nobody's, so the network does not only repeat the
    patterns. None: the sample holds no span.
    """
    docs = sampled(pick(df, doc_id=id_col, text=text_col).where("text is not null"), "doc_id", sample_docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                windows = _windows(encode(text)).tolist()
                tags = bytearray(len(text)) if windows else b""
                for kind, a, b in base_spans(text) if windows else []:
                    tags[a:b] = bytes([KINDS.index(kind) + 1]) * (b - a)
                rows += [(text[w : w + WIDTH], bytes(tags[w : w + WIDTH]).hex()) for w in windows]
            yield pd.DataFrame(rows, columns=["text", "tags"])

    got = docs.select("text").mapInPandas(cut, "text string, tags string").distinct().orderBy(F.xxhash64("text")).limit(most_windows).collect()
    pairs = [(t, list(bytes.fromhex(g))) for t, g in got]
    if not any(any(g) for _, g in pairs):
        return None
    rng = random.Random(9)
    pairs += [v for t, g in pairs for v in _variants(rng, t, g)]
    tagger = Tagger()
    labels = np.array([(g + [0] * WIDTH)[:WIDTH] for _, g in pairs])
    tagger.train(np.stack([_padded(encode(t), 0) for t, _ in pairs]), labels)
    return tagger


def find_personal(df: DataFrame, text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """df with base and spans: what the patterns find, and that with what the network adds.

    Spans are (kind, start, end) in code points, end exclusive, by kind as
    listed and then start. Windows of 64 characters that overlap by half cover
    every place near a digit or an @; without either, no kind can occur. Their
    tags are decoded by the CRF and reconciled over the whole text. Added spans
    pass their kind's check and overlap no base span. A null or empty text has
    no spans; repeated rows and null ids keep a row each; an empty table gives
    an empty one. Columns named base or spans are replaced, all others pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers

    def start():
        def scan(texts: list) -> list[list]:
            tagger = shared.value
            base = [base_spans(t) if t else [] for t in texts]
            both = base
            if tagger:
                more = predicted(tagger, [t or "" for t in texts])
                both = [sorted(b + _added(t, c, b, m), key=lambda s: (KINDS.index(s[0]), s[1])) if m else b for t, b, (c, m) in zip(texts, base, more, strict=True)]
            return [[[{"kind": x, "start": s, "end": e} for x, s, e in v] for v in lists] for lists in (base, both)]

        return scan

    return with_columns(df, text_col, start, f"base {SPANS}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from find_personal()."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
