"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics. Per class, mean and covariance
come from sums the executors form; the covariance is shrunk towards the pooled one and
towards a multiple of the identity. Scores are differences of Mahalanobis log densities,
computed by solving with the Cholesky factors kept in the model, plus the log prior odds.

The fit reads at most ``max_fit_rows`` labelled rows, those with the smallest id hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import crc_mod, fresh, sigmoid

FEATURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "distinct", "repeat", "lines", "stops", "top_word",
)
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
#: Features are rounded to multiples of 1 / GRID, so sums over the fit rows are exact in any order.
GRID = 4096
UPPER, DIGIT, SYMBOL = 1, 2, 4


def character_kinds() -> np.ndarray:
    """Per code point: upper or title case, decimal digit, symbol."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for bit, pattern in ((DIGIT, r"\d"), (SYMBOL, r"[^\w\s.,;:'\"()\-]")):
        kinds[[m.start() for m in re.finditer(pattern, every)]] |= bit
    kinds[[i for i, c in enumerate(every) if c.isupper() or c.istitle()]] |= UPPER
    return kinds


KINDS = character_kinds()


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; all ratios are 0 for a text without words."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [np.log1p(chars), *[0.0] * (len(FEATURES) - 1)]
    letters = chars - text.count(" ")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(KINDS[codes], minlength=8)
    upper, digits, marks = (int(kinds[[k for k in range(8) if k & bit]].sum()) for bit in (UPPER, DIGIT, SYMBOL))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        float(np.log(letters / n)),
        float(np.sqrt(upper / letters)),
        float(np.sqrt(digits / letters)),
        float(np.sqrt(marks / letters)),
        len(counts) / n,
        float(np.sqrt(same / n)),
        float(np.sqrt(text.count("\n") / n)),
        float(np.sqrt((text.count(".") + text.count(",")) / n)),
        float(np.sqrt(max(counts.values()) / n)),
    ]


@dataclass
class Discriminant:
    """Class 1 against class 0; ``factors`` are the cached Cholesky factors."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        log_density = [
            -0.5 * (np.linalg.solve(self.factors[c], (z - self.means[c]).T) ** 2).sum(axis=0) - 0.5 * self.log_dets[c]
            for c in (0, 1)
        ]
        return sigmoid(log_density[1] - log_density[0] + self.log_odds)


@dataclass
class Constant:
    """Stands in when the labels hold fewer than two classes."""

    value: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(n: np.ndarray, total: np.ndarray, square: np.ndarray, to_pooled: float = 0.4, to_identity: float = 0.02):
    """Model from the per-class counts, sums and sums of outer products."""
    if not n.all():
        return Constant(0.5 if not n.any() else float(n[1] > 0))
    d = total.shape[1]
    shift = total.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(square.sum(axis=0)) / n.sum() - shift**2, 0)) + 1e-6
    raw = [total[c] / n[c] for c in (0, 1)]
    cov = [(square[c] / n[c] - np.outer(raw[c], raw[c])) / np.outer(scale, scale) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    factors, log_dets = [], []
    for c in (0, 1):
        s = (1 - to_pooled) * cov[c] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-6) * np.eye(d)
        f = np.linalg.cholesky(s)
        factors.append(f)
        log_dets.append(2 * np.log(np.diag(f)).sum())
    means = np.array([(m - shift) / scale for m in raw])
    return Discriminant(shift, scale, means, np.array(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def pick_labels(labels: DataFrame, id_col: str, label_col: str, held_out: Column, max_fit_rows: int) -> DataFrame:
    """At most ``max_fit_rows`` labelled ids for training, those with the smallest id hash.

    Null ids and labels are left out; an id with contradicting labels counts as 1.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out)
    one = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(max_fit_rows)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, modulus: int, max_fit_rows: int
) -> Discriminant | Constant:
    picked = pick_labels(labels, id_col, label_col, crc_mod(F.col(id_col), modulus) == 0, max_fit_rows)
    # Bounded by max_fit_rows, so this side may be broadcast at any input size.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    d = len(FEATURES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((2, 1 + d + d * d))
        for pdf in batches:
            if len(pdf):
                x = np.rint(np.array([statistics(t) for t in pdf["text"]]) * GRID) / GRID
                y = pdf["y"].to_numpy() > 0
                for c in (0, 1):
                    z = x[y == bool(c)]
                    acc[c] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel()))
        width = acc.shape[1]
        yield pd.DataFrame({"c": np.repeat([0, 1], width), "at": np.tile(np.arange(width), 2), "v": acc.ravel()})

    got = rows.select("text", "y").mapInPandas(sums, "c int, at int, v double").groupBy("c", "at").agg(F.sum("v").alias("v"))
    acc = np.zeros((2, 1 + d + d * d))
    for r in got.collect():  # 2 * (1 + d + d * d) rows at any input size
        acc[r["c"], r["at"]] = r["v"]
    return fit(acc[:, 0], acc[:, 1 : 1 + d], acc[:, 1 + d :].reshape(2, d, d))


def with_score(docs: DataFrame, model: Discriminant | Constant, *, text_col: str = "text", into: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.scores(x))

    return docs.withColumn(into, score(docs[text_col]))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 5,
    into: str = "score",
    max_fit_rows: int = MAX_FIT_ROWS,
) -> DataFrame:
    """``docs`` with a score in [0, 1] in ``into``: how likely label 1 is.

    Ids whose CRC-32 is divisible by ``modulus`` never train. Null and empty texts get the
    score of an empty text; rows are scored one by one, so repeated rows repeat; an empty
    table stays empty. Without labels of both classes the score is the one class seen, or
    0.5. Only the named columns are read; a column named ``into`` is replaced.
    """
    model = train(
        docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, modulus=modulus, max_fit_rows=max_fit_rows
    )
    return with_score(docs, model, text_col=text_col, into=into)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """``docs`` without the rows that score under the threshold."""
    score = fresh(docs, "quality_score")
    return score_quality(docs, labels, into=score, **settings).where(F.col(score) >= threshold).drop(score)
