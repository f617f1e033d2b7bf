"""Quality classifier (1): a document's evidence joined with what is known of its host and path, by hierarchical empirical Bayes.

Evidence is the log odds that an additive logistic model over text statistics gives, less its prior: what the text alone
says.  The rate of good documents of a host is a beta-binomial mean shrunk to the global rate, that of a path within the
host is shrunk to the host's; how strongly, is estimated by moments from how much hosts, and paths within hosts, differ
beyond chance.  A site with few documents thus says little of its own.  The posterior of a document adds its evidence to
the log odds of its path.

All of this is grouped sums: paths from documents, hosts from paths, one row from hosts.  Sums are combined before they
are shuffled, so a host with a third of all documents costs a row for each task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, keep_rows, staged, text_key

#: At most so many labelled documents, those with the smallest hashes of their ids, fit the document classifier.
TRAIN_ROWS = 20_000
BINS, RIDGE, ROUNDS = 12, 1.0, 25
LEAST_SCORE = 0.5
#: Bounds of the estimated strength of shrinking, in documents.
WEAKEST, STRONGEST = 2.0, 1e6
FEATURES = ("log_words", "word_length", "long_words", "symbols", "digits", "capitals", "distinct_words", "repeated_pairs", "repeated_lines", "words_in_line")
_ASCII = bytes(range(128))
_SYMBOLS, _DIGITS, _CAPITALS = b"#*$%&|<>{}[]~^_=+\\/@", b"0123456789", bytes(range(65, 91))


def features(text: str | None) -> list[float]:
    """Ten statistics of a whole text; zeros if it has no word."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), sum(map(len, words))
    low = [w.lower() for w in words]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = lambda chars: size - len(b"".join(words).translate(None, chars))
    pairs = Counter(zip(low, low[1:], strict=False))
    return [
        float(np.log1p(n)), size / n, sum(len(w) > 20 for w in words) / n, count(_SYMBOLS) / size, count(_DIGITS) / size, count(_CAPITALS) / size,
        len(set(low)) / n, sum(c for c in pairs.values() if c > 1) / n, 1 - len(set(lines)) / len(lines), n / len(lines)]


@dataclass
class Additive:
    """Logistic regression on the quantile bins of each feature."""

    edges: np.ndarray  # features x cuts
    weights: np.ndarray  # features x bins
    bias: float
    prior: float  # log odds of good among the labelled

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray) -> Additive:
        """Newton steps with a ridge; without documents of both kinds the evidence is zero everywhere."""
        width = x.shape[1]
        prior = float(np.log((good.sum() + 1) / (len(good) - good.sum() + 1)))
        if not len(good) or good.all() or not good.any():
            return cls(np.zeros((width, BINS - 1)), np.zeros((width, BINS)), prior, prior)
        edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        for j in range(width):  # half way to the next value that occurs, so that a cut never touches one
            values = np.unique(x[:, j])
            at = np.searchsorted(values, edges[j], side="right")
            edges[j] = (values[at - 1] + values[np.minimum(at, len(values) - 1)]) / 2
        model = cls(edges, np.zeros((width, BINS)), prior, prior)
        d = np.concatenate((model._design(x), np.ones((len(x), 1))), axis=1)
        w = np.zeros(d.shape[1])
        w[-1] = prior
        penalty = np.full(len(w), RIDGE)
        penalty[-1] = 1e-6
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (good - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        model.weights, model.bias = w[:-1].reshape(width, BINS), float(w[-1])
        return model

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > self.edges[None]).sum(axis=2)

    def _design(self, x: np.ndarray) -> np.ndarray:
        bins = self._bins(x)
        return (bins[:, :, None] == np.arange(BINS)).reshape(len(x), -1).astype(float)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds less the prior ones."""
        bins = self._bins(x)
        return self.weights[np.arange(x.shape[1]), bins].sum(axis=1) + self.bias - self.prior


def feature_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """row_id, row_text, site (host and path) and the features of every row, written once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py()) for t in batch.column(4)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], ["row_id", "row_text", "host", "path", "x"])

    source = docs.select(F.col(id_col).alias("row_id"), text_key(F.col(text_col)).alias("row_text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    kind = source.schema["row_id"].dataType.simpleString()
    rows = source.mapInArrow(each, f"row_id {kind}, row_text bigint, host string, path string, x array<double>")
    return staged(rows.select("row_id", "row_text", F.struct("host", "path").alias("site"), "x"), "features")


def with_evidence(rows: DataFrame, model: Additive) -> DataFrame:
    """Replaces the features by ``evidence``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy().reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.evidence(x))], ["row_id", "row_text", "site", "evidence"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.select("row_id", "row_text", "site", "x").mapInArrow(each, f"row_id {kind}, row_text bigint, site struct<host: string, path: string>, evidence double")


def strength(groups: DataFrame, center: Column) -> float:
    """Pseudo-count of a beta prior for groups (n, good) around ``center``, by the method of moments."""
    rate = F.col("good") / F.col("n")
    row = groups.agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (rate - center) * (rate - center)).alias("s"),
        F.sum(F.col("n") * center * (1 - center)).alias("v")).first()
    if not row.m or row.m < 2 or not row.v:
        return STRONGEST
    chance = row.v / row.n
    beyond = (row.s - (row.m - 1) * chance) / (row.n - row.nn / row.n) if row.n > row.nn / row.n else 0.0
    return STRONGEST if beyond <= 0 else float(np.clip(chance / beyond - 1, WEAKEST, STRONGEST))


def site_rates(judged: DataFrame, prior_good: float) -> DataFrame:
    """For each site its count ``n`` and the shrunk rates host_rate and path_rate, from rows of (site, good in 0..1)."""
    paths = staged(judged.groupBy("site").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    hosts = staged(paths.groupBy(F.struct("site.host").alias("host")).agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (total[1] + prior_good) / (total[0] + 1) if total[0] else prior_good
    k = strength(hosts, F.lit(overall))
    hosts = hosts.select("host", ((F.col("good") + k * F.lit(overall)) / (F.col("n") + k)).alias("host_rate"))
    joined = staged(paths.withColumn("host", F.struct("site.host")).join(hosts, "host"), "sites")
    k = strength(joined, F.col("host_rate"))
    return joined.select("site", "n", "host_rate", ((F.col("good") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def fitting_rows(rows: DataFrame, known: DataFrame, limit: int = TRAIN_ROWS) -> list:
    """The ``limit`` labelled rows with the smallest hashes of their ids.  Those with a hash that many more would precede
    are left out before any task sends rows, so that what reaches the driver does not grow with the table."""
    labelled = rows.select("row_id", "x").join(known, "row_id")
    n = labelled.count()
    share = (limit + 6 * limit**0.5) / max(n, 1)  # by six deviations enough
    if share < 1:
        labelled = labelled.filter(F.xxhash64("row_id") < F.lit(int((2 * share - 1) * (1 << 63))))
    return labelled.orderBy(F.xxhash64("row_id"), "row_id").limit(limit).collect()


def score_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_id_col: str = "doc_id") -> DataFrame:
    rows = feature_rows(docs, id_col, text_col, host_col, path_col)
    label_id = F.col(label_id_col)
    known = labels.filter(label_id.isNotNull() & F.col("quality").isNotNull()).groupBy(label_id.alias("row_id")).agg(F.min("quality").alias("quality"))
    sample = fitting_rows(rows, known)
    x = np.array([r.x for r in sample], float).reshape(-1, len(FEATURES))
    model = Additive.fit(x, np.array([r.quality > 0 for r in sample], float))
    scored = staged(with_evidence(rows, model), "evidence")
    good = 1 / (1 + F.exp(-(F.col("evidence") + model.prior)))
    sites = staged(site_rates(scored.select("site", good.alias("good")), 1 / (1 + float(np.exp(-model.prior)))), "site-rates")
    joined = attach(scored, sites, "site", "n")
    rate = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.ln(rate / (1 - rate)))))
    return joined.select("row_id", "row_text", "site", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= LEAST_SCORE).alias("kept"))


def classify_quality(
        docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score and kept of every row of ``docs``.

    ``labels`` has doc_id and quality (0 is bad); of several labels of a document the lowest counts, null is none.  Without
    labels of both kinds texts give no evidence, and without any label everything is kept.  Null and empty texts have all
    statistics zero; a null host or path is a site of its own; repeated rows give a row each; null ids stay null and have
    no label.  Other columns play no part; an empty table gives no rows.  Documents without a URL are placed by the two
    columns given; for pages these are the host and a front part of the path."""
    return score_rows(docs, labels, id_col, text_col, host_col, path_col).withColumnRenamed("row_id", "doc_id").drop("row_text", "site")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The documents that ``classify_quality`` keeps, with all their columns, repeated rows too; rows of one id and text are
    judged by their own host and path."""
    kept = score_rows(docs, labels, id_col, text_col, host_col, path_col).filter("kept").select("row_id", "row_text", "site.host", "site.path").distinct()
    return keep_rows(docs, staged(kept, "quality"), {"row_id": F.col(id_col), "row_text": text_key(F.col(text_col)), "host": F.col(host_col).cast("string"), "path": F.col(path_col).cast("string")})
