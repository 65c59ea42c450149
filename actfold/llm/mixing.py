"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import NULL_KEY, Scratch, numbered, pick, short_batches, with_columns

#: Cells are broadcast only up to this many (a few MB); beyond it they are joined by a shuffle.
MOST_BROADCAST = 20_000
#: Words are hashed to this many places, a byte of the hash.
PLACES = 256


def word_places(text: str | None) -> tuple[int, np.ndarray | None]:
    """Words of a text (runs without ASCII white space), and how many of them fall to each place; None: no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0, None
    last = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint8)[7::8]  # the hash modulo 256
    return len(words), np.bincount(last, minlength=PLACES)


def word_counts(text: str | None) -> tuple[int, np.ndarray | None]:
    """Words of a text, and their shares by place at unit length; None: no words."""
    size, n = word_places(text)
    return size, None if n is None else n / np.linalg.norm(n)


def with_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with words (how many fall to each place, in the narrowest whole numbers that hold them; null: no words) and tokens (words; null: 0), from one pass over the texts; columns so named are replaced."""

    def start():
        def run(texts: list) -> list[list]:
            found = [word_places(text) for text in texts]
            return [[None if n is None else n.astype(np.min_scalar_type(n.max())).tobytes() for _, n in found], [size for size, _ in found]]

        return run

    return with_columns(df, text_col, start, "words binary, tokens long")


def _units(words: pa.Array) -> np.ndarray:
    """Rows of shares by place at unit length."""
    sizes, n = pc.binary_length(words).to_numpy(zero_copy_only=False), np.empty((len(words), PLACES))
    for size in np.unique(sizes).tolist():  # counts of 1, 2, 4 or 8 bytes
        own = sizes == size
        same = words.filter(pa.array(own)).cast(pa.binary(size))
        n[own] = np.frombuffer(same.buffers()[1], f"u{size // PLACES}", len(same) * PLACES, same.offset * size).reshape(-1, PLACES)
    return np.divide(n, np.sqrt(np.einsum("ij,ij->i", n, n))[:, None], out=n)


@dataclass(frozen=True)
class Topics:
    """Centres of word use, after what is common to a language is taken off, so that a topic is no language over again."""

    means: dict[str, np.ndarray]
    mean: np.ndarray
    centres: np.ndarray

    def of(self, units: np.ndarray, langs: list) -> list[str]:
        """The topic of each row of units; a null language is NULL_KEY."""
        values = list(dict.fromkeys(langs))
        off = np.stack([self.centres @ self.means.get(v, self.mean) for v in values])
        at = {v: i for i, v in enumerate(values)}
        near = (units @ self.centres.T - off[[at[v] for v in langs]]).round(9)
        return [f"topic {k}" for k in near.argmax(axis=1).tolist()]


#: Steps of a document's shares in 16 bits, and of a centred one in sums of whole numbers, which are the same in any order.
STEPS, FINE = 32_767, 1 << 20
#: Scores that differ by more than this stay apart when they are brought to unit length (at most 2) and rounded to 9 digits.
APART = 1e-8


def _shares(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A batch of (lang, words) as rows of shares in whole steps, each row's place in the list of languages, and that list."""
    x = _units(batch.column(1))
    langs = batch.column(0).dictionary_encode()
    return np.rint(np.multiply(x, STEPS, out=x), out=x), langs.indices.to_numpy(), langs.dictionary.to_pylist()


def _centred(shares: np.ndarray, langs: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows at unit length, what is common to their language taken off."""
    x = shares / STEPS
    x -= off[langs]
    return np.divide(x, np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), out=x)


def _nearest(shares: np.ndarray, langs: np.ndarray, off: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equals (to 9 digits) the first. Only rows whose best two are close are centred for it."""
    scores = shares @ (centres.T / STEPS) - (off @ centres.T)[langs]
    own = scores.argmax(axis=1)
    best = scores[np.arange(len(own)), own]
    scores[np.arange(len(own)), own] = -np.inf
    close = np.flatnonzero(best - scores.max(axis=1) < APART)
    if len(close):
        own[close] = (_centred(shares[close], langs[close], off) @ centres.T).round(9).argmax(axis=1)
    return own


def _summed(units: DataFrame, of: Callable[[pa.RecordBatch], Iterator[tuple[str, int, np.ndarray]]]) -> dict[str, tuple[int, np.ndarray]]:
    """For each of a few keys how many rows it has and their sum; of gives both for a batch. A task sends 257 rows a key, the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for key, n, x in of(batch) if batch.num_rows else ():
                total[key] = total.get(key, 0) + np.append(x, n)
        for key, x in total.items():
            yield pa.RecordBatch.from_pydict({"key": [key] * len(x), "place": np.arange(len(x)), "n": x})

    out: dict[str, np.ndarray] = {}
    for key, place, n in units.mapInArrow(run, "key string, place long, n long").groupBy("key", "place").agg(F.sum("n")).collect():
        out.setdefault(key, np.zeros(PLACES + 1, np.int64))[place] = n
    return {key: (int(x[-1]), x[:-1]) for key, x in out.items()}


def fit_topics(df: DataFrame, text_col: str = "text", lang_col: str = "lang", topics: int = 8, least_docs: int = 20, rounds: int = 25, seed: int = 7, work: Scratch | None = None) -> Topics | None:
    """fit_words() on a table of texts: these are read once, and their words written meanwhile."""
    work = work or Scratch(df.sparkSession)
    found = work.save(with_words(pick(df, text=text_col, lang=lang_col)).select("lang", "words"), "words")
    fitted = fit_words(found, topics=topics, least_docs=least_docs, rounds=rounds, seed=seed)
    work.drop(found)
    return fitted


def fit_words(df: DataFrame, lang_col: str = "lang", topics: int = 8, least_docs: int = 20, rounds: int = 25, seed: int = 7) -> Topics | None:
    """Spherical k-means over the word use of all documents, given as a written table of with_words().

    Each round reads the words (256 bytes for most documents) and sums them by
    centre in Spark, so only sums reach the driver. After the first round only
    documents that go to another centre are summed. Sums are of whole numbers,
    so the centres are the same however the rows are dealt. Each next first
    centre is what the others are furthest from. It ends when a round changes
    nothing, or after ``rounds``.

    A language (a null one is one of its own) with fewer than ``least_docs``
    documents, or one in 200, is centred at the mean of all. None: no document
    with words.
    """
    short_batches(df.sparkSession)
    units = df.where("words is not null").select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NULL_KEY)).alias("lang"), "words")
    n = units.count()
    if not n:
        return None
    common = frozenset(r.lang for r in units.groupBy("lang").count().where(F.col("count") >= max(least_docs, n // 200)).collect())

    def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
        x, at, langs = _shares(batch)
        for k, lang in enumerate(langs):
            yield lang if lang in common else "", int((at == k).sum()), x[at == k].sum(axis=0).astype(np.int64)

    sums = _summed(units, by_lang)
    means = {lang: sums[lang][1] / sums[lang][0] / STEPS for lang in common}
    mean = sum(x for _, x in sums.values()) / n / STEPS

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, at, langs = _shares(batch)
        return x, at, np.stack([means.get(lang, mean) for lang in langs])

    def furthest(centres: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                if batch.num_rows:
                    x = _centred(*placed(batch))
                    near = np.array([xxhash.xxh3_64_intdigest(r.tobytes(), seed) / 2**64 for r in x]) if centres is None else (x @ centres.T).max(axis=1).round(9)
                    least = min((near[i], x[i].tobytes()) for i in np.flatnonzero(near == near.min()))
                    best = least if best is None else min(best, least)
            if best:
                yield pa.RecordBatch.from_pydict({"near": [float(best[0])], "x": [best[1]]})

        return np.frombuffer(units.mapInArrow(run, "near double, x binary").agg(F.min(F.struct("near", "x")).alias("m")).first().m.x)

    centres = furthest(None)[None]
    while len(centres) < min(topics, n):
        centres = np.concatenate((centres, furthest(centres)[None]))
    last, before = None, None
    size, total = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64)
    for _ in range(rounds):
        now, then = centres, last

        def moves(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
            x, at, off = placed(batch)
            own = _nearest(x, at, off, now)  # noqa: B023
            was = np.full(len(own), -1) if then is None else _nearest(x, at, off, then)  # noqa: B023
            go = np.flatnonzero(own != was)
            x, own, was = np.rint(_centred(x[go], at[go], off) * FINE).astype(np.int64), own[go], was[go]
            for sign, side in ((1, own), (-1, was)):
                for k in set(side.tolist()) - {-1}:
                    yield str(k), sign * int((side == k).sum()), sign * x[side == k].sum(axis=0)

        for k, (count, x) in _summed(units, moves).items():
            size[int(k)] += count
            total[int(k)] += x
        sums = np.where(size[:, None] > 0, total / FINE, centres)
        if before is not None and np.array_equal(sums, before):
            break
        last, before, centres = centres, sums, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return Topics(means, mean, centres)


def with_topics(df: DataFrame, topics: Topics | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df with topic (``none`` without words) and tokens (words; null: 0), from one pass over the texts; columns so named are replaced."""
    own, at = numbered(df)
    found = with_words(own, at[text_col]).withColumn("topic", topic(topics, F.col("words"), F.col(at[lang_col])))
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in ("topic", "tokens")]
    return found.select(*[own.columns[i] for i in keep], "topic", "tokens").toDF(*[df.columns[i] for i in keep], "topic", "tokens")


def topic(topics: Topics | None, words: Column, lang: Column) -> Column:
    """The topic of each document by the words of with_words(); ``none`` without words."""
    if topics is None:
        return F.lit("none")

    @F.arrow_udf("string")
    def nearest(words: pa.Array, lang: pa.Array) -> pa.Array:
        there = words.is_valid()
        found = iter(topics.of(_units(words.filter(there)), lang.filter(there).to_pylist()) if pc.any(there).as_py() else ())
        return pa.array([next(found) if t else "none" for t in there.to_pylist()], pa.string())

    return nearest(words, F.coalesce(lang.cast("string"), F.lit(NULL_KEY)))


def rake(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame], total: float, work: Scratch, tolerance: float = 1e-4, most_rounds: int = 50) -> tuple[DataFrame, int, float]:
    """cells(*margins, tokens, weight) whose weights meet every target(value, share), the rounds taken, the worst margin's error.

    A round scales the weights to each margin in turn by grouped sums and
    joins; the first sums of a round tell how far off the last one left them.
    Targets that contradict each other, or the empty cells, end after
    ``most_rounds`` at the best fit of that round; the error says so, as the
    largest difference of a value's share from its target.
    """
    error, rounds = math.inf, 0
    while True:
        off = []
        for m in margins:
            sums = cells.groupBy(m).agg(F.sum("weight").alias("_now")).join(targets[m].select(F.col("value").alias(m), "share").hint("merge"), m, "left")
            off.append(sums.agg(F.max(F.abs(F.col("_now") / total - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0)
        error = max(off)
        if error <= tolerance or rounds == most_rounds:
            return cells, rounds, error
        rounds += 1
        fitted = cells
        for m in margins:
            scale = fitted.groupBy(m).agg(F.sum("weight").alias("_now")).join(targets[m].select(F.col("value").alias(m), "share").hint("merge"), m, "left")
            scale = scale.select(m, F.when(F.col("_now") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("_now")).otherwise(0.0).alias("_scale"))
            fitted = fitted.join(scale.hint("merge"), m).withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale")
        fitted = work.save(fitted, "raked")
        if rounds > 1:
            work.drop(cells)
        cells = fitted


def rake_few(cells: list, margins: list[str], targets: dict[str, dict[str, float]], total: float, tolerance: float = 1e-4, most_rounds: int = 50) -> tuple[np.ndarray, int, float]:
    """rake() for cells that are few enough to be broadcast, in numpy: their weights, the rounds taken, the worst margin's error."""
    weight = np.array([c["weight"] for c in cells], dtype=np.float64)
    sides = []
    for m in margins:
        values, own = np.unique([c[m] for c in cells], return_inverse=True)
        sides.append((own, np.array([targets[m].get(v, 0.0) for v in values.tolist()]) * total))
    for rounds in range(most_rounds + 1):
        error = max(float(np.abs(np.bincount(own, weight, len(want)) - want).max()) / total for own, want in sides)
        if error <= tolerance or rounds == most_rounds:
            break
        for own, want in sides:
            now = np.bincount(own, weight, len(want))
            weight = weight * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[own]
    return weight, rounds, error


def smoothed_targets(cells: DataFrame, margins: list[str], power: float, work: Scratch) -> dict[str, DataFrame]:
    """Each margin's observed shares to a power, made to sum to 1."""
    out = {}
    for m in margins:
        sums = work.save(cells.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0"), f"margin-{m}")
        norm = sums.agg(F.sum(F.pow("n", F.lit(power)))).first()[0] or 1.0
        out[m] = sums.select("value", (F.pow("n", F.lit(power)) / norm).alias("share"))
    return out


def calibrate(cells: DataFrame, budget: float) -> float:
    """c with sum(tokens * least(1, c * weight / tokens)) = budget, by grids of 32 multipliers, one pass each."""
    live = cells.where("weight > 0 and tokens > 0")
    low, high, most = live.agg(F.min(F.col("tokens") / F.col("weight")), F.max(F.col("tokens") / F.col("weight")), F.sum("tokens")).first()
    if low is None:
        return 0.0
    if budget >= most:
        return float(high)
    low = min(low, 1.0) * 1e-6
    for _ in range(5):
        grid = [low * (high / low) ** (k / 31) for k in range(32)]
        kept_of = live.agg(*[F.sum(F.least(F.col("tokens").cast("double"), F.col("weight") * c)).alias(f"k{i}") for i, c in enumerate(grid)]).first()
        above = next((i for i in range(32) if kept_of[i] >= budget), 31)
        low, high = grid[max(0, above - 1)], grid[above]
    return high


def drawn(id_col: Column, seed: int) -> Column:
    """A number from 0 to 1 that a hash of the id gives."""
    return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.lit(NULL_KEY)), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def mix(df: DataFrame, margins: list[str], tokens_col: str = "tokens", targets: dict[str, DataFrame] | None = None, keep: float = 0.7, power: float = 0.5, seed: int = 7, id_col: str = "doc_id", work: Scratch | None = None) -> DataFrame:
    """Every row with the columns _cell (its margins' values), _weight, _probability, _kept and _error added.

    Tokens are summed by cell (the values of all margins together) and raked
    to the targets(value, share) of each margin. Without targets, each margin's
    observed shares are flattened by ``power``. A cell's probability is
    least(1, c * weight / tokens), where c makes the tokens kept in expectation
    the ``keep`` share of all. A row stays if a hash of its id falls below that:
    repeated rows share their fate, and a run again decides alike. ``_error``
    is how far the worst margin's share is from its target in the end, over
    0.0001 only where targets contradict each other or the empty cells. Up to
    20,000 cells are raked in the driver, which broadcasts them anyway; more
    are raked by grouped sums and joins.

    A null value of a margin is a value of its own, null tokens count 0. Values
    without a target are dropped, targets without rows are ignored. Rows
    without tokens keep weight 0 and stay out; an empty table gives an empty
    one. Further columns of any name pass through; those named like the added
    ones are replaced.
    """
    spark = df.sparkSession
    work = work or Scratch(spark)
    own, at = numbered(df)
    names = [f"m{i}" for i in range(len(margins))]
    cell = F.struct(*[F.coalesce(F.col(at[m]).cast("string"), F.lit(NULL_KEY)).alias(n) for m, n in zip(margins, names, strict=True)])
    rows = own.withColumn("_at", cell)
    tokens = F.coalesce(F.col(at[tokens_col]).cast("long"), F.lit(0))
    cells = work.save(rows.select("_at.*", tokens.alias("tokens")).groupBy(*names).agg(F.sum("tokens").alias("tokens")).withColumn("weight", F.col("tokens").cast("double")), "cells")
    total, n_cells = cells.agg(F.sum("tokens"), F.count("*")).first()
    total = float(total or 0)
    if targets is None:
        wanted = smoothed_targets(cells, names, power, work)
    else:
        wanted = {n: _present(targets[m], cells, n, work) for m, n in zip(margins, names, strict=True)}
    fitted, error = cells, 0.0
    if total and n_cells <= MOST_BROADCAST:  # then the driver holds them to broadcast their rates
        few = cells.collect()
        weights, _, error = rake_few(few, names, {n: {r["value"]: r["share"] for r in t.collect()} for n, t in wanted.items()}, total)
        fitted = spark.createDataFrame([(*(c[n] for n in names), c["tokens"], w) for c, w in zip(few, weights.tolist(), strict=True)], cells.schema)
    elif total:
        fitted, _, error = rake(cells, names, wanted, total, work)
    c = calibrate(fitted, keep * total)
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * c / F.col("tokens"))).otherwise(0.0)
    rates = fitted.select(F.struct(*names).alias("_at"), F.col("weight").alias("_weight"), chance.alias("_probability"))
    out = rows.join(F.broadcast(rates) if n_cells <= MOST_BROADCAST else rates.hint("merge"), "_at")
    shown = F.struct(*[F.col(f"_at.{n}").alias(m) for m, n in zip(margins, names, strict=True)])
    added = [shown.alias("_cell"), F.col("_weight"), F.col("_probability"), (drawn(F.col(at[id_col]), seed) < F.col("_probability")).alias("_kept"), F.lit(error).alias("_error")]
    place = [i for i, c in enumerate(df.columns) if c.lower() not in ("_cell", "_weight", "_probability", "_kept", "_error")]
    return out.select(*[own.columns[i] for i in place], *added).toDF(*[df.columns[i] for i in place], "_cell", "_weight", "_probability", "_kept", "_error")


def _present(target: DataFrame, cells: DataFrame, margin: str, work: Scratch) -> DataFrame:
    """The target's values that have rows, their shares made to sum to 1."""
    wanted = target.select(F.coalesce(F.col("value").cast("string"), F.lit(NULL_KEY)).alias("value"), F.col("share").cast("double").alias("share")).where("share > 0")
    there = work.save(wanted.join(cells.where("tokens > 0").select(F.col(margin).alias("value")).distinct().hint("merge"), "value", "left_semi"), f"target-{margin}")
    norm = there.agg(F.sum("share")).first()[0] or 1.0
    return there.withColumn("share", F.col("share") / norm)


MARGINS = ["source", "lang", "topic"]


def mix_documents(docs: DataFrame, keep: float = 0.7, work: Scratch | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens and what mix() adds, by source, language and fitted topic, tokens being words.

    The texts are read once: what the fit of the topics and the rest need is
    written then. Null or empty texts have topic ``none`` and no tokens.
    """
    work = work or Scratch(docs.sparkSession)
    counted = work.save(with_words(pick(docs, doc_id="doc_id", text="text", source="source", lang="lang")).drop("text"), "counted")
    slim = counted.withColumn("topic", topic(fit_words(counted), F.col("words"), F.col("lang"))).select("doc_id", *MARGINS, "tokens")
    slim = work.save(slim, "measured")
    work.drop(counted)
    return mix(slim, MARGINS, keep=keep, work=work)


def sample_documents(docs: DataFrame, keep: float = 0.7, work: Scratch | None = None) -> DataFrame:
    """The documents that mix_documents() keeps, their columns as they are.

    Words are counted once: the documents are written with them, the fit and
    the sums of the cells read the counts alone, and the draw reads all.
    """
    work = work or Scratch(docs.sparkSession)
    own, at = numbered(docs)
    counted = work.save(with_words(own, at["text"]), "counted")
    measured = counted.withColumn("topic", topic(fit_words(counted, at["lang"]), F.col("words"), F.col(at["lang"])))
    mixed = mix(measured, [at["source"], at["lang"], "topic"], keep=keep, id_col=at["doc_id"], work=work)
    return mixed.where("_kept").select(*own.columns).toDF(*docs.columns)
