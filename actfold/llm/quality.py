"""Quality classifier: document evidence with host and path posteriors, shrunk by hierarchical empirical Bayes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actfold.llm.common import NULL_KEY, Scratch, pick, sampled, with_columns

FEATURES = ("log_words", "word_length", "upper", "digit", "mark", "symbol", "distinct_words", "distinct_pairs", "line_repeats", "longest_word", "short_words")
#: Sites are broadcast only up to this many (a few MB).
MOST_BROADCAST = 20_000
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 3
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4


def features(text: str | None) -> list[float]:
    """What the form of a whole text says, in a few numbers; all 0 for none."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=5) / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(len(words))),
        float(sizes.mean()),
        *(float(k) for k in kinds[1:]),
        len(set(words)) / len(words),
        pairs / max(1, len(words) - 1),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(sizes.max())),
        float((sizes <= 3).mean()),
    ]


class Logistic:
    """Ridge logistic regression on standardised features and their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self.design(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, z * z - 1), axis=1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.w, -30, 30)))


def fit(scored: DataFrame, sample_rows: int = 20_000) -> Logistic | None:
    """From about ``sample_rows`` labelled rows (_features, _label); None unless both labels occur."""
    got = sampled(scored.where("_label is not null"), "_key", sample_rows).select("_features", "_label").collect()
    if len({r[1] > 0.5 for r in got}) < 2:
        return None
    return Logistic(np.array([r[0] for r in got]), np.array([float(r[1] > 0.5) for r in got]))


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Prior strength by moments from groups(good, n): large where groups differ no more than chance explains; within 1 to 1e4."""
    n, k = F.sum("n"), F.count("*")
    between = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, F.lit(2.0)))
    noise = F.sum(mean * (1 - mean))
    excess = (between - noise) / F.greatest(n - F.sum(F.col("n") * F.col("n")) / n, F.lit(1e-9))
    return F.when((k > 1) & (excess > 0), F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.avg(mean * (1 - mean)) / excess - 1))).otherwise(F.lit(1e4))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def classify(df: DataFrame, labels: DataFrame, host: str, path: str, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", least: float = 0.5, work: Scratch | None = None) -> DataFrame:
    """id, host, path, doc_prob, host_post, path_post, quality, keep for every row.

    ``doc_prob`` is a logistic model of the text's form, fitted on a bounded
    sample of labelled rows. Labels are summed by path and host; a host's
    posterior is drawn to the share of all labels, a path's to its host's, with
    strengths by the method of moments, so a sparse site follows what is above
    it. ``quality`` moves the document's log-odds by those of its path against
    all. A labelled document's own label is taken out of its site's sums.

    Without labels of both kinds everything has quality 0.5. Null hosts and
    paths are one site each; an id with several labels takes their mean;
    repeated rows and null ids keep a row each; null or empty texts have all
    features 0; an empty table gives an empty one. Other columns are left out.
    """
    spark = df.sparkSession
    work = work or Scratch(spark)
    key = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit(NULL_KEY), F.xxhash64("_text").cast("string")))  # null ids have no label; their keys are spread
    slim = pick(df, _id=id_col, _text=text_col, host=host, path=path).select("_id", "_text", key.alias("_key"), *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)).alias(c) for c in ("host", "path")])
    scored = with_columns(slim, "_text", lambda: lambda texts: [[features(t) for t in texts]], "_features array<double>").drop("_text")
    marks = pick(labels, key=label_id, label=label_col).where("key is not null and label is not null").groupBy(F.col("key").cast("string").alias("_key")).agg(F.avg(F.col("label").cast("double")).alias("_label"))
    scored = work.save(scored.join(marks.hint("merge"), "_key", "left"), "features")
    model = spark.sparkContext.broadcast(fit(scored))

    def judge(rows: list) -> list[list]:
        if model.value is None or not rows:
            return [[0.5] * len(rows)]
        return [model.value.chance(np.array(rows)).tolist()]

    judged = with_columns(scored, "_features", lambda: judge, "doc_prob double").drop("_features")
    by_path = work.save(scored.where("_label is not null").groupBy("host", "path").agg(F.sum("_label").alias("good"), F.count("*").cast("double").alias("n")), "paths")
    good, n = by_path.agg(F.sum("good"), F.sum("n")).first()
    mean = float(good / n) if n else 0.5
    by_host = by_path.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    s_host = float(by_host.agg(_strength(by_host, F.lit(mean))).first()[0] or 1e4)
    with_host = by_path.join(by_host.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n")).hint("merge"), "host")
    inner = with_host.withColumn("m", (F.col("host_good") + s_host * mean) / (F.col("host_n") + s_host))
    s_path = float(inner.agg(_strength(inner, F.col("m"))).first()[0] or 1e4)
    sites = work.save(with_host.select("host", "path", "good", "n", "host_good", "host_n"), "sites")
    hosts = work.save(by_host.select("host", F.col("good").alias("h_good"), F.col("n").alias("h_n")), "hosts")
    # A path or a host without labels has no row there, and takes what is above it.
    # Few sites go to every task, which spares the exchange of all rows on a handful of keys; many are joined by a shuffle.
    spread = F.broadcast if sites.count() <= MOST_BROADCAST else lambda t: t.hint("merge")
    rows = judged.join(spread(sites.drop("host_good", "host_n")), ["host", "path"], "left").join(spread(hosts), "host", "left")
    own, one = F.coalesce("_label", F.lit(0.0)), F.when(F.col("_label").isNotNull(), 1.0).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    host_post = (zero("h_good") - own + s_host * mean) / (zero("h_n") - one + s_host)
    rows = rows.withColumn("host_post", host_post)
    rows = rows.withColumn("path_post", (zero("good") - own + s_path * F.col("host_post")) / (zero("n") - one + s_path))
    odds = _logit(F.col("doc_prob")) + _logit(F.col("path_post")) - _logit(F.lit(mean))
    rows = rows.withColumn("quality", F.when(F.lit(n is None or not 0 < mean < 1), 0.5).otherwise(1 / (1 + F.exp(-odds))))
    return rows.select(F.col("_id").alias(id_col), "host", "path", "doc_prob", "host_post", "path_post", "quality", (F.col("quality") >= least).alias("keep"))
