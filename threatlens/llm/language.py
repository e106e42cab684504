"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of
character n-grams (n from 1 to 4, lower case, runs of other characters as one
space) that both hold, over the root of the product of how many each holds.
N-grams are hashed to ``DIMENSIONS`` places.  A Nystroem map on landmark texts
turns one-versus-rest kernel ridge regression into a small linear problem.  As
the kernel with a landmark is linear in a text's presence vector, landmarks and
weights fold into one matrix, and tasks score batches by matrix products.

The model is fitted on a bounded sample: ``SAMPLE`` training rows in all, spread
over languages, drawn by hash of the id; every row is scored.  Whole texts
count, in the sample too.

Null texts and texts without a letter get ``und`` with score 0; so does every
text if there is no training row.  Ties go to the language first by name.
Rows with equal ids are scored each; a null id is neither held out nor learnt
from.  Other columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens.llm import shared

ORDERS = 4
DIMENSIONS = 1 << 16
SAMPLE = 2000           # training rows at most
LANDMARKS = 200         # of them
RIDGE = 1e-2
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_OTHERS = re.compile(r"[\W\d_]+")
_BLOCK = 1 << 20        # characters hashed at a time
_ROWS = 64              # rows of one matrix product


def letters(text: str | None) -> str:
    """Lower-case words with single spaces around; empty if there is no letter."""
    kept = _OTHERS.sub(" ", (text or "").lower())
    return f" {kept.strip()} " if any(map(str.isalpha, kept)) else ""


def mark(text: str, row: np.ndarray) -> None:
    """Sets the places of the n-grams of ``letters`` text in a row of zeros."""
    for at in range(0, len(text), _BLOCK):
        codes = np.frombuffer(text[at:at + _BLOCK + ORDERS - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        mixed = codes
        for n in range(ORDERS):
            if n:
                mixed = mixed[:-1] * np.uint32(0x01000193) + codes[n:]
            row[((mixed + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(16)] = 1


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray         # DIMENSIONS x languages
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        presence = np.zeros((_ROWS, DIMENSIONS), np.float32)
        for at in range(0, len(texts), _ROWS):
            kept = [letters(t) for t in texts[at:at + _ROWS]]
            presence[:] = 0
            for row, text in zip(presence, kept):
                mark(text, row)
            rows = presence[:len(kept)]
            norms = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))
            found = (rows @ self.weights) / norms + self.bias
            best = found.argmax(1)
            sure = np.clip((found[np.arange(len(kept)), best] + 1) / 2, 0, 1)
            names += [self.languages[b] if t else UNKNOWN for b, t in zip(best, kept)]
            scores += [round(float(s), 6) if t else 0.0 for s, t in zip(sure, kept)]
        return names, scores


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from (language, packed presence bits) rows in a fixed order."""
    languages = tuple(sorted({name for name, _ in rows}))
    if not languages:
        return None
    bits = [np.frombuffer(b, np.uint8) for _, b in rows]
    place = {name: i for i, name in enumerate(languages)}
    y = np.full((len(rows), len(languages)), -1.0)
    y[np.arange(len(rows)), [place[name] for name, _ in rows]] = 1
    seen: dict[str, int] = {}
    turn = []
    for i, (name, _) in enumerate(rows):        # the first of every language, then the second, ...
        seen[name] = seen.get(name, 0) + 1
        turn.append((seen[name], i))
    chosen = [i for _, i in sorted(turn)[:landmarks]]

    def unit(which):
        dense = np.array([np.unpackbits(bits[i]) for i in which], np.float32)
        return dense / np.sqrt(np.maximum(dense.sum(1, keepdims=True), 1))
    base = unit(chosen)
    kernel = np.vstack([unit(range(at, min(at + _ROWS, len(rows)))) @ base.T for at in range(0, len(rows), _ROWS)])
    values, vectors = np.linalg.eigh((base @ base.T).astype("f8"))
    good = values > 1e-6 * max(values.max(), 1e-9)
    root = vectors[:, good] / np.sqrt(values[good])             # Nystroem: kernel @ root are the features
    features = kernel.astype("f8") @ root
    mean, offset = features.mean(0), y.mean(0)
    centred = features - mean
    coefficients = np.linalg.solve(centred.T @ centred + ridge * len(rows) * np.eye(centred.shape[1]),
                                   centred.T @ (y - offset))
    return Model(languages, (base.T @ (root @ coefficients).astype(np.float32)),
                 (offset - mean @ coefficients).astype(np.float32))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, bytes]]:
    """At most ``size`` training rows as presence bits, as many of each language as can be."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
                        & ~held_out()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "lang").limit(size).collect()}
    if not counts:
        return []
    each = max(1, size // len(counts))
    grain = 1 << 30
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(grain))
    # about twice what is needed, then exactly the first of each language
    near = F.lit(False)
    for name, n in counts.items():
        near = near | ((F.col("lang") == name) & (draw < min(grain, 2 * each * grain // n + 1)))
    text = F.xxhash64("text")
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "tie")
    keys = (usable.withColumn("draw", draw).where(near).withColumn("tie", text)
            .withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= each))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch["text"].to_pylist():
            row = np.zeros(DIMENSIONS, np.uint8)
            mark(letters(text), row)
            out.append(np.packbits(row).tobytes())
        return pa.RecordBatch.from_arrays([batch["lang"], batch["turn"], pa.array(out, pa.binary())],
                                          ["lang", "turn", "bits"])
    rows = shared.by_batch(keys.select("lang", "turn", "text"), make, "lang string, turn int, bits binary").collect()
    return [(r.lang, bytes(r.bits)) for r in sorted(rows, key=lambda r: (r.lang, r.turn))]


def identify(docs: DataFrame, size: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """Learns on the training rows and predicts all: doc_id, held_out, lang_pred, score."""
    shared.prepare(docs.sparkSession)
    model = fit(sample(docs, size), landmarks)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        names, scores = model.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          ["doc_id", "lang_pred", "score"])
    found = shared.by_batch(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
