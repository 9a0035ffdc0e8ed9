"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are the trigrams of its byte classes (letters, capitals, digits,
marks by kind, white space), its hashed letter bigrams, and marks of
repetition (a word equal to the one before, words and lines seen before).  Term
shares, damped by a square root and weighted by idf, are projected on the
leading right singular vectors of a bounded labelled sample.  The sample's
vectors are broadcast; every document's cosine products with all of them are
computed in blocks, and the labels of the ``NEIGHBOURS`` nearest vote, each
with its similarity to the power ``SHARPNESS``.

The sample holds at most ``PER_CLASS`` documents of each label, so the broadcast
is at most 2 * PER_CLASS * (RANK + 1) floats and the terms' projection
TERMS * RANK floats, whatever the corpus.  Inputs of a score are the text alone.

Defined cases: a null or empty text has no terms and no neighbours and scores
0; with no labelled documents all scores are 0; a text's score depends on the
text only, so repeated rows score alike; a null id is kept; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import need
from isoweave.llm.labelled import labelled_sample

PER_CLASS, RANK, NEIGHBOURS, SHARPNESS, BLOCK = 3000, 48, 15, 4, 512
CUT = 0.7

#: Byte classes: letters, capitals, digits, blank, line end, other space, one class a mark, bytes beyond ASCII.
_MARKS = b".,!?*$#&%|\"'-:/"
_CLASS = np.full(256, 7 + len(_MARKS), np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord(" ")] = 3
_CLASS[10] = 4
_CLASS[[9, 11, 12, 13]] = 5
_CLASS[128:] = 6
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 7 + _k
CLASSES = 8 + len(_MARKS)
LETTER_TERMS = 1024
TERMS = CLASSES**3 + LETTER_TERMS + 4
_WORD = re.compile(rb"\S+")


def term_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The terms that occur and the damped share of each."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.float32)
    c = _CLASS[b]
    shape = np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3) if len(b) > 2 else np.zeros(CLASSES**3, np.int64)
    low = b.astype(np.int64) | 32
    letters = np.bincount((low[:-1] * 131 + low[1:]) % LETTER_TERMS, minlength=LETTER_TERMS) if len(b) > 1 else np.zeros(LETTER_TERMS, np.int64)
    words, lines = _WORD.findall(text), text.split(b"\n")
    n = max(1, len(words))
    again = sum(x == y for x, y in zip(words, words[1:], strict=False))
    counts = np.concatenate((shape / len(b), letters / len(b), [again / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines), 1 / n]))
    at = np.flatnonzero(counts)
    return at, np.sqrt(counts[at]).astype(np.float32)


def dense(terms: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(terms), TERMS), np.float32)
    for row, (at, v) in zip(out, terms, strict=True):
        row[at] = v
    return out


def leading_vectors(a: np.ndarray, rank: int, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of ``a``, by subspace iteration."""
    rank = min(rank, *a.shape)
    q = np.random.default_rng(seed).standard_normal((a.shape[1], rank + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


class LatentNeighbours:
    """The fitted model: projection (terms x rank), unit vectors and labels of the sample."""

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK):
        a = dense(terms)
        idf = np.log1p(len(a) / (1 + np.count_nonzero(a, axis=0))).astype(np.float32)
        a *= idf
        self.projection = leading_vectors(a, rank) * idf[:, None] if len(a) else np.zeros((TERMS, 1), np.float32)
        self.vectors, self.labels = unit(dense(terms) @ self.projection), labels.astype(np.float32)

    def score(self, texts: list[bytes | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            terms = [term_counts(t or b"") for t in texts[at : at + BLOCK]]
            own = unit(np.stack([v @ self.projection[t] for t, v in terms]))
            sim = own @ self.vectors.T
            near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(sim, near, 1), 0) ** SHARPNESS
            vote = (weight * self.labels[near]).sum(1) / np.maximum(weight.sum(1), 1e-12)
            out[at : at + BLOCK] = np.where([len(t) > 0 for t, _ in terms], np.clip(vote, 0, 1), 0)
        return out


def fit(sample: DataFrame) -> LatentNeighbours:
    """Fit on (text, label) rows; their number must be bounded, as a sample's is."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "at": pa.array([f[0].tolist() for f in found], pa.list_(pa.int32())), "v": pa.array([f[1].tolist() for f in found], pa.list_(pa.float32()))})

    src = sample.select("id", F.col("text").cast("binary").alias("text"), "label")
    rows = src.mapInArrow(terms, "id long, label int, at array<int>, v array<float>").toArrow()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    at, v, labels = rows.column("at").combine_chunks(), rows.column("v").combine_chunks(), rows.column("label").to_numpy()
    found = [(at[i].values.to_numpy().astype(np.int64), v[i].values.to_numpy()) for i in order.tolist()]
    return LatentNeighbours(found, labels[order])


def score_quality(docs: DataFrame, model: LatentNeighbours, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of every row."""
    need(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "score": pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())})

    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, f"`{id_col}` long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", keep=None, per_class: int = PER_CLASS, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labelled rows that ``keep`` leaves, then score all: id_col, score, predicted."""
    sample, _ = labelled_sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col, keep=keep)
    scored = score_quality(docs, fit(sample), id_col=id_col, text_col=text_col)
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
