"""Toxicity: cumulative-link ordinal regression on sparse word features.

A word's terms are the word itself and its prefixes of 4 to 8 letters, so that
compounds of one stem share a term.  Terms are chosen on a bounded labelled
sample in two steps: the ``TERMS`` most tied to toxicity by the chi-square of
their document counts, and among those a greedy cover of the toxic documents
(each until ``COVER`` chosen terms hit it), so that words which only stand
beside toxic ones don't get in.

The labels say only toxic or not.  Grade 0 is not toxic; toxic documents fall into
grades 1 to 3 by how toxic they look to scorers that haven't seen them: the sample
is dealt into ``PARTS`` by a hash of the id, and a document's score is the sum of the
log odds of its terms among the documents of the other parts.  Terciles of that
score are the grades, so what a term weighs comes from how it stands with the
labels, not from how often it is said.  A document's features are log(1 + count)
of each term and of all hits together.  P(grade <= k) = sigmoid(cut_k - w.x),
with one weight vector for all ordered cuts; the sample's classes are weighted
back to their shares among all labels.  Expected severity is the mean grade.  A
document is rejected if grade 0 has a probability below one half.

Defined cases: a null or empty text has no words and gets the severity of the
empty feature vector; with no toxic labels nothing is rejected; a text's score
depends on the text only; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need
from isoweave.llm.labelled import labelled_sample

PER_CLASS, TERMS, COVER, GRADES, PARTS = 4000, 2000, 3, 4, 5
#: A term must gain at least so many toxic documents, and this share of them.
LEAST_DOCS, LEAST_SHARE = 5, 0.01
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in range(4, min(len(word), 9)))]


def least_docs(n_toxic: int) -> float:
    return max(LEAST_DOCS, LEAST_SHARE * n_toxic)


def toxic_terms(sample: DataFrame, n_toxic: int, n_clean: int, terms: int = TERMS) -> list[str]:
    """At most ``terms`` terms, by the chi-square of their document counts on the toxic side."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update({t for w in set(words_of(text)) for t in terms_of(w)})
            names = list({*toxic, *clean})
            yield pa.RecordBatch.from_pydict({"term": pa.array(names, pa.string()), "t": pa.array([toxic[w] for w in names], pa.int64()), "c": pa.array([clean[w] for w in names], pa.int64())})

    counts = sample.select("text", "label").mapInArrow(distinct, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t") + 0.0, F.col("c") + 0.0
    n = n_toxic + n_clean
    chi = n * F.pow(t * (n_clean - c) - c * (n_toxic - t), 2) / F.greatest((t + c) * (n - t - c), F.lit(1.0))
    rich = counts.filter((t >= least_docs(n_toxic)) & (t * n_clean > 5 * c * n_toxic))
    return [r.term for r in rich.orderBy(chi.desc(), "term").limit(terms).collect()]


def cover(hits: list[list[int]], toxic: np.ndarray, size: int) -> list[int]:
    """Terms that cover the toxic documents, each ``COVER`` times, at few clean ones."""
    docs: list[list[int]] = [[] for _ in range(size)]
    for d, own in enumerate(hits):
        for k in set(own):
            docs[k].append(d)
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    price = [10 * n_toxic / n_clean * int((~toxic[np.array(x, int)]).sum()) for x in docs]
    left, chosen = np.where(toxic, COVER, 0), []
    while True:
        gains = [(sum(left[d] > 0 for d in x) - y, -k) for k, (x, y) in enumerate(zip(docs, price, strict=True)) if x]
        gain, k = max(gains, default=(0, 0))
        if gain < least_docs(n_toxic):
            return sorted(chosen)
        chosen.append(-k)
        left[docs[-k]] -= 1
        docs[-k] = []


def held_out_scores(hits: list[list[list[int]]], toxic: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """Per document the log odds of its terms, summed, as the documents of all other parts have them."""
    terms = [sorted({k for own in h for k in own}) for h in hits]
    total, seen = np.zeros((PARTS, 2)), np.zeros((PARTS, 2, size))
    for own, t, p in zip(terms, toxic.astype(int), part, strict=True):
        total[p, t] += 1
        seen[p, t, own] += 1
    total, seen = total.sum(0) - total, seen.sum(0) - seen
    odds = np.log((seen + 0.5) / (total[:, :, None] + 1))
    return np.array([(odds[p, 1, own] - odds[p, 0, own]).sum() for own, p in zip(terms, part, strict=True)])


class OrdinalModel:
    """Chosen terms, weights and ordered cuts."""

    def __init__(self, terms: list[str], weights: np.ndarray, cuts: np.ndarray):
        self.index, self.weights, self.cuts = {t: k for k, t in enumerate(terms)}, weights, cuts
        self.stems = {t[:4] for t in terms}

    def hits(self, text: str | None) -> list[list[int]]:
        """Per word that hits any, its terms."""
        found = []
        for w in words_of(text):
            if (w[:4] in self.stems or len(w) < 4) and (own := [self.index[t] for t in terms_of(w) if t in self.index]):
                found.append(own)
        return found

    @staticmethod
    def features(hits: list[list[int]], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and values: log counts of the terms, then of the words that hit any."""
        at, n = np.unique(np.array([k for own in hits for k in own], np.int64), return_counts=True)
        return np.append(at, size), np.append(np.log1p(n), np.log1p(len(hits)))

    def grades(self, texts: list[str | None]) -> np.ndarray:
        """Per text the probability of each grade."""
        logit = np.empty(len(texts))
        for k, text in enumerate(texts):
            at, v = self.features(self.hits(text), len(self.index))
            logit[k] = self.weights[at] @ v
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - logit[:, None], -500, 500)))
        return np.diff(np.hstack((np.zeros((len(texts), 1)), below, np.ones((len(texts), 1)))), axis=1)


def fit_ordinal(x: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, weight: np.ndarray, size: int, rounds: int = 600, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights (non-negative: every feature speaks for toxicity) and cuts, by Adam on the weighted likelihood."""
    row = np.repeat(np.arange(len(x)), [len(a) for a, _ in x])
    at, v = np.concatenate([a for a, _ in x]), np.concatenate([b for _, b in x])
    w, first, gaps = np.full(size + 1, 0.1), np.array([1.0]), np.zeros(GRADES - 2)
    weight = weight / weight.sum()
    m, s = [np.zeros_like(p) for p in (w, first, gaps)], [np.zeros_like(p) for p in (w, first, gaps)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate((first, np.exp(gaps))))
        z = np.bincount(row, v * w[at], len(x))
        pad = np.concatenate(([-np.inf], cuts, [np.inf]))
        hi, lo = sig(pad[grade + 1] - z), sig(pad[grade] - z)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        g_cut = np.bincount(grade, -d_hi, GRADES)[: GRADES - 1] + np.bincount(grade, d_lo, GRADES)[1:]
        grads = (np.bincount(at, v * (d_hi - d_lo)[row], size + 1) + l2 * w, np.array([g_cut.sum()]), np.array([g_cut[k + 1 :].sum() for k in range(GRADES - 2)]) * np.exp(gaps))
        for k, (param, g) in enumerate(zip((w, first, gaps), grads, strict=True)):
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
            param -= 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        np.maximum(w, 0, out=w)
    return w, np.cumsum(np.concatenate((first, np.exp(gaps))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = PER_CLASS, keep=None, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on at most ``per_class`` labelled documents a class; without both labels nothing is toxic."""
    sample, counts = labelled_sample(docs, labels, label, per_class, id_col=id_col, text_col=text_col, keep=keep)
    work = Workspace(docs.sparkSession, "toxicity")
    sample = work.save(sample, "sample")
    sizes = {int(r.label): int(r.n) for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        work.drop("sample")
        return OrdinalModel([], np.zeros(1), np.array([10.0, 11.0, 12.0]))
    terms = toxic_terms(sample, sizes[1], sizes[0])
    index = OrdinalModel(terms, np.zeros(len(terms) + 1), np.zeros(GRADES - 1))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [index.hits(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "label": batch.column(2), "hits": pa.array(hits, pa.list_(pa.list_(pa.int32())))})

    rows = sorted(sample.select("id", "text", "label").mapInArrow(encode, "id long, label int, hits array<array<int>>").toArrow().to_pylist(), key=lambda r: (r["id"], r["label"], r["hits"]))
    work.drop("sample")
    toxic = np.array([r["label"] == 1 for r in rows])
    chosen = cover([[k for own in r["hits"] for k in own] for r in rows], toxic, len(terms))
    place = {k: n for n, k in enumerate(chosen)}
    hits = [[kept for own in r["hits"] if (kept := [place[k] for k in own if k in place])] for r in rows]
    part = np.array([zlib.crc32(b"%d" % r["id"]) % PARTS for r in rows])
    severe = held_out_scores(hits, toxic, part, len(chosen))
    cuts = np.quantile(severe[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, severe), 0)
    weight = np.where(toxic, counts[1] / sizes[1], counts[0] / sizes[0])
    x = [OrdinalModel.features(h, len(chosen)) for h in hits]
    return OrdinalModel([terms[k] for k in chosen], *fit_ordinal(x, grade, weight, len(chosen)))


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with severity (0 to 3), p_toxic, grade (the likeliest) and rejected, in place of columns so named."""
    need(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def score(text):
        import pandas as pd

        p = shared.value.grades(text.tolist())
        return pd.DataFrame({"severity": p @ np.arange(GRADES), "p_toxic": 1 - p[:, 0], "grade": p.argmax(1).astype("int32")})

    scored = docs.withColumn("__score", score(F.col(text_col).cast("string")))
    kept = [c for c in docs.columns if c.lower() not in ("severity", "p_toxic", "grade", "rejected")]
    return scored.select(*kept, "__score.severity", "__score.p_toxic", "__score.grade", (F.col("__score.p_toxic") > 0.5).alias("rejected"))
