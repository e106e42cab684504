"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics.  Per class the mean and
covariance come from sums over all labelled training rows (never a sample); the
covariance is shrunk towards its diagonal.  The score is the posterior of class
1: the difference of the Gaussian log densities, computed from Mahalanobis
distances with the inverse Cholesky factors that every task holds ready, plus
the log prior odds.

Null and empty texts have the statistics of an empty text and are scored like
any other.  Rows with equal ids are scored each; a null id is never labelled
nor held out.  Labels other than 0 and 1 do not count.  If a class has no
labelled row, every score is the share of class 1 (0.5 without any label).
Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens.llm import shared

SHRINKAGE = 0.1     # weight of the diagonal in each class covariance
PRIOR_WORDS = 10    # words of no particular kind that every share counts besides a text's own
RIDGE = 1e-2        # added to the diagonal, in units of the pooled variance
FOLDS, HELD_OUT = 3, 1

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BREAKS = np.frombuffer(b"!?", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)
NAMES = ("bytes", "words", "word_length", "length_spread", "upper", "symbols", "digits", "breaks", "stops", "bars",
         "short_words", "distinct_words", "top_word", "repeats", "line_length", "equal_lines", "open_lines")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a UTF-8 text, in the order of NAMES; shares are square-rooted, sizes logged."""
    size = len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [float(np.log1p(size))] + [0.0] * (len(NAMES) - 1)
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper, lower = int(of[65:91].sum()), int(of[97:123].sum())
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    m, long = n + PRIOR_WORDS, size + 6 * PRIOR_WORDS       # short texts stay near the middle of each share
    mean = long / m
    return [float(x) for x in (
        np.log1p(size), np.log1p(n), np.log(mean), np.log1p(lengths.std() * n / m / mean),
        np.sqrt(upper / (upper + lower + 6 * PRIOR_WORDS)),
        np.sqrt(of[_SYMBOLS].sum() / long), np.sqrt(of[48:58].sum() / long), np.sqrt(of[_BREAKS].sum() / m),
        np.sqrt(of[_STOPS].sum() / m), np.sqrt(of[124] / m), np.sqrt((lengths <= 3).sum() / m),
        np.log1p(len(tally)) / np.log1p(n), np.sqrt(max(tally.values()) / m), np.sqrt(repeats / m),
        np.log1p(n / len(lines)), np.sqrt((len(lines) - len(set(lines))) / (len(lines) + 3)),
        np.sqrt(sum(line.rstrip()[-1:] not in b".!?:\"')" for line in lines) / (len(lines) + 3)))]


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors of both classes; without factors the share alone counts."""

    share: float
    means: np.ndarray | None = None         # 2 x d
    factors: np.ndarray | None = None       # 2 x d x d, lower triangular inverses
    offset: float = 0.0                     # log prior odds minus half the difference of log determinants

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.share)
        far = [(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip(self.offset + (far[0] - far[1]) / 2, -500, 500)))


def fit(sums: dict[int, np.ndarray], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """A model from each class's flat sums: rows, x, and x times x transposed."""
    d = len(NAMES)
    n = {c: s[0] for c, s in sums.items() if s[0] > 0}
    if len(n) < 2:
        return Model(share=n.get(1, 0.0) / sum(n.values()) if n else 0.5)
    means = np.array([sums[c][1:d + 1] / n[c] for c in (0, 1)])
    spread = [sums[c][d + 1:].reshape(d, d) / n[c] - np.outer(m, m) for c, m in zip((0, 1), means)]
    pooled = np.maximum(sum(n[c] * s.diagonal() for c, s in zip((0, 1), spread)) / sum(n.values()), 1e-6)
    factors, logs = [], []
    for s in spread:
        diagonal = np.diag(np.maximum(s.diagonal(), 0))
        covariance = (1 - shrinkage) * s + shrinkage * diagonal + ridge * np.diag(pooled)
        cholesky = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(cholesky))
        logs.append(2 * np.log(cholesky.diagonal()).sum())
    return Model(n[1] / sum(n.values()), means, np.array(factors), float(np.log(n[1] / n[0]) + (logs[0] - logs[1]) / 2))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def featured(docs: DataFrame) -> DataFrame:
    """row_no, doc_id and statistics ``x`` of every row."""
    d = len(NAMES)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in shared.raw_texts(batch["text"])], "f8").ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, d), pa.int32()), pa.array(x))
        return pa.RecordBatch.from_arrays([batch["row_no"], batch["doc_id"], lists], ["row_no", "doc_id", "x"])
    return shared.by_batch(shared.numbered(docs, "doc_id", "text"), make, "row_no long, doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy().reshape(batch.num_rows, len(NAMES))


def train(features: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Model:
    """Fits on all rows of ``features`` that have a label and are not held out."""
    d = len(NAMES)
    marked = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out())
    rows = features.join(marked, "doc_id").select("x", F.col("quality").cast("int").alias("quality"))

    def local(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch), batch["quality"].to_numpy()
            for c in (0, 1):
                of = x[y == c]
                total[c] += np.concatenate([[len(of)], of.sum(0), (of.T @ of).ravel()])
        at = np.arange(total.shape[1])
        for c in (0, 1):
            if total[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, "i4")), pa.array(at.astype("i4")),
                                                  pa.array(total[c])], ["quality", "position", "value"])
    parts = rows.mapInArrow(local, "quality int, position int, value double")
    sums = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in parts.groupBy("quality", "position").agg(F.sum("value").alias("value")).collect():
        sums[r.quality][r.position] = r.value
    return fit(sums, shrinkage, ridge)


def score(features: DataFrame, model: Model) -> DataFrame:
    """row_no, doc_id and score of every row of ``features``."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.round(model.score(_matrix(batch)), 9)
        return pa.RecordBatch.from_arrays([batch["row_no"], batch["doc_id"], pa.array(found)],
                                          ["row_no", "doc_id", "score"])
    return shared.by_batch(features, make, "row_no long, doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on the labelled rows of ``docs`` and scores all: row_no, doc_id, held_out, score, predicted."""
    shared.prepare(docs.sparkSession)
    features = shared.staged(featured(docs), "statistics")
    found = score(features, train(features, labels))
    return found.select("row_no", "doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5; ``docs`` must be read from files."""
    stay = scored(docs, labels).where("predicted = 1")
    return shared.only_rows(docs, stay)
