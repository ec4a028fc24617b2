"""Quality classifier: regularised quadratic discriminant over document statistics.

Every whole text becomes ``STATISTICS`` numbers: lengths, shares of character classes and
word repetition, brought near to a normal shape by logarithms and square roots. Each class
has a mean and a covariance shrunk towards the pooled covariance and towards a multiple of
the identity. A score is the logistic of the prior log-odds plus the difference of the two
Gaussian log-densities; the Mahalanobis terms use the inverse Cholesky factors cached in the
model. Labels are read by the fit only; a score depends on the text alone.

Class moments are summed by Spark over all labelled rows that are not held out, so the driver
receives one row per class and moment, whatever the input.

Null text counts as empty and is scored like any text. Rows with a null label are not learned
from. With a single learned class every score is 0 or 1 for that class; without labels it is
0.5. Repeated rows get equal scores; an empty table gives an empty result; columns of any name
are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out

THRESHOLD = 0.7
POOLED_SHARE, IDENTITY_SHARE = 0.2, 0.01
#: Every text counts as this much ordinary prose on top, so shares of short texts are not extreme.
PRIOR_WORDS, PRIOR_CHARS = 12, 72

STATISTICS = (
    "log_chars", "log_words", "log_word_bytes", "sqrt_upper", "sqrt_digit", "sqrt_symbol", "sqrt_exclaim",
    "sqrt_pipe", "sqrt_stop", "sqrt_blank", "sqrt_line", "sqrt_repeat", "log_distinct", "sqrt_top_word",
)

_UPPER, _LOWER = slice(0x41, 0x5B), slice(0x61, 0x7B)
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]=+_/\\`", np.uint8)


def text_statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, from its UTF-8 bytes; bytes from 0x80 on count as letters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw) + PRIOR_CHARS
    words = raw.split()
    k = len(words) + PRIOR_WORDS
    upper = int(count[_UPPER].sum())
    letters = upper + int(count[_LOWER].sum()) + int(count[0x80:].sum()) + PRIOR_CHARS
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    root = lambda a, b: float(np.sqrt(a / b))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log((n - int(count[0x20])) / k)),
        root(upper, letters), root(int(count[0x30:0x3A].sum()), n), root(int(count[_SYMBOLS].sum()), n),
        root(int(count[0x21] + count[0x3F]), n), root(int(count[0x7C]), n), root(int(count[0x2E] + count[0x2C]) + PRIOR_WORDS / 8, k),
        root(int(count[0x20]) + PRIOR_WORDS, n), root(int(count[0x0A]), k), root(repeats, k),
        float(np.log((len(seen) + PRIOR_WORDS) / k)), root(max(seen.values(), default=0), k),
    ]


def statistics_matrix(texts: pd.Series) -> np.ndarray:
    return np.array([text_statistics(t if isinstance(t, str) else None) for t in texts], float).reshape(len(texts), len(STATISTICS))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pd.Series) -> pd.Series:
    return pd.Series(list(statistics_matrix(texts)))


@dataclass(frozen=True)
class Discriminant:
    """Learned classes with mean, inverse Cholesky factor and log-density constant each."""

    prior: tuple[float, float]
    mean: np.ndarray
    whiten: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if min(self.prior) == 0:
            return np.full(len(x), 0.5 if max(self.prior) == 0 else float(self.prior[1] > 0))
        density = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        odds = np.log(self.prior[1] / self.prior[0]) + density[1] - density[0]
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


def class_moments(learn: DataFrame) -> DataFrame:
    """(label, stats) rows to (label, i, j, total): counts at (-1, -1), sums at (i, -1), products at (i, j)."""
    d = len(STATISTICS)
    sums = [F.sum(F.lit(1.0)).alias("n")] + [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]
    sums += [F.sum(F.col("stats")[i] * F.col("stats")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    one = learn.groupBy("label").agg(*sums)
    cells = [F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("n").alias("v"))]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), F.col(f"s{i}").alias("v")) for i in range(d)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"p{i}_{j}").alias("v")) for i in range(d) for j in range(i, d)]
    return one.select("label", F.explode(F.array(*cells)).alias("c")).select("label", "c.i", "c.j", F.col("c.v").alias("total"))


def fit(stats: DataFrame, labels: DataFrame, pooled: float = POOLED_SHARE, identity: float = IDENTITY_SHARE) -> Discriminant:
    """Learn from ``stats`` (doc_id, stats) joined with ``labels`` (doc_id, quality), without held-out rows."""
    learn = stats.where(~held_out(F.col("doc_id"))).join(
        labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id"
    ).select("label", "stats")
    d = len(STATISTICS)
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for label, i, j, v in class_moments(learn).collect():  # two classes times 120 moments
        if i < 0:
            n[label] = v
        elif j < 0:
            s[label, i] = v
        else:
            p[label, i, j] = p[label, j, i] = v
    if n.min() == 0:
        total = max(1.0, n.sum())
        return Discriminant((n[0] / total, n[1] / total), s, p, np.zeros(2))
    mean = s / n[:, None]
    scatter = p - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    common = scatter.sum(axis=0) / n.sum()
    whiten, constant = np.empty((2, d, d)), np.empty(2)
    for k in (0, 1):
        own = (1 - pooled) * scatter[k] / n[k] + pooled * common
        cov = (1 - identity) * own + identity * (np.trace(own) / d + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten[k] = np.linalg.inv(factor)
        constant[k] = -np.log(np.diag(factor)).sum()
    return Discriminant((n[0] / n.sum(), n[1] / n.sum()), mean, whiten, constant)


def score(model: Discriminant, text: Column) -> Column:
    """Score of a whole text: probability-like, higher when label 1 is likelier."""

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics_matrix(texts)))

    return of_text(text)


def score_statistics(model: Discriminant, stats: Column) -> Column:
    @F.pandas_udf("double")
    def of_stats(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(len(rows), len(STATISTICS))))

    return of_stats(stats)


def with_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), statistics(F.col(text)).alias("stats"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; a map over the rows, nothing is shuffled."""
    (s,) = fresh(docs, "score")
    return docs.withColumn(s, score(model, F.col(text))).where(F.col(s) >= threshold).drop(s)
