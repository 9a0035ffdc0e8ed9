"""Importance resampling towards a target: draw the documents that look most like the target's texts.

Words are runs of letters, digits and bytes beyond ASCII of the text with A-Z in
lower case; features are all single words and all pairs of neighbours, hashed by
crc32 into ``BUCKETS`` buckets.  A bucket's gain is the scaled logarithm of its
smoothed share in the target over that in the corpus, a document's weight the
floored mean of its features' gains.  Gumbel noise from a hash of the id turns
weights into scores, of which the highest are drawn: a sample without
replacement in proportion to the weights.

Method: two passes over the texts in Arrow batches.  The first counts buckets by
``np.bincount`` into one vector a partition, and ``treeReduce`` merges the vectors
(``BUCKETS`` numbers each, whatever the corpus).  The second gathers the broadcast
gains of each feature and sums them for each document by ``bincount`` weights.
The crc32 of a pair is put together from those of its words, so no pair is ever
written out.  A worker keeps no words, takes ``BATCH`` texts at a time and works on
about ``BLOCK`` features at once, so its memory doesn't grow with the vocabulary.

Drawing sorts nothing whole.  Scores are whole numbers within the gains' range
plus the noise's (about -3200 to 23,000), so their histogram has a bounded number
of rows; it gives each score's first rank, and rows are numbered by id within one
score only.  Even where all texts are alike the noise puts at most 0.04 % of all
ids on one score.

Defined cases: a null text has no words; a document without features has weight
0; a null id is hashed as the empty text and comes last among equals; repeated
rows of one id have the same noise and each a rank of their own; an empty target
or corpus counts as zeros; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, arrow_rows, held, need, word_lists

BUCKETS = 10_000
#: Bytes of text, and about so many features, that are worked on together.
PIECE, BLOCK = 1 << 18, 100_000
#: Rows of an Arrow batch.
BATCH = 500
_LONGEST = 64

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@functools.cache
def _zeros_after() -> tuple[np.ndarray, np.ndarray]:
    """[k, n, b]: what byte k of a crc register adds, if its value is b, once n zero bytes have passed through; the same of a blank's crc for each n."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    table = np.zeros((4, _LONGEST + 2, 256), np.uint32)
    for k in range(4):
        table[k, 0] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _LONGEST + 2):
        table[:, n] = (table[:, n - 1] >> np.uint32(8)) ^ one[table[:, n - 1] & 0xFF]
    blank = zlib.crc32(b" ")
    return table, np.bitwise_xor.reduce([table[k, :, blank >> 8 * k & 0xFF] for k in range(4)])


class Features:
    """The buckets of texts' features, about ``block`` features at a time."""

    def __init__(self, buckets: int = BUCKETS, block: int | None = None):
        self.buckets, self.block = buckets, block or BLOCK

    def of_words(self, words: list[bytes], joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of all words, and of those pairs (a word and the next) that ``joined`` marks."""
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        first = np.flatnonzero(joined)
        size = np.fromiter(map(len, words), np.int64, len(words))[first + 1]
        # crc(x + y) = crc(y) xor what the register crc(x) becomes after len(y) zero bytes: for x a blank, and for x a word before blank and word
        (table, blank), short, start = _zeros_after(), np.minimum(size, _LONGEST), crc[first]
        pair = crc[first + 1] ^ blank[short]
        at = (short + 1) * 256
        for byte in range(4):
            pair ^= table[byte].ravel()[at + ((start >> np.uint32(8 * byte)) & np.uint32(0xFF))]
        for i in np.flatnonzero(size > _LONGEST).tolist():
            pair[i] = zlib.crc32(b" " + words[first[i] + 1], int(start[i]))
        return crc % np.uint32(self.buckets), pair % np.uint32(self.buckets)

    def of_texts(self, texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (row, bucket) of all features, with the rows of all words; long texts come in several blocks."""
        words: list[bytes] = []
        rows: list[int] = []
        sizes: list[int] = []
        for row, text in enumerate(texts):
            if len(text or b"") <= PIECE:
                own = (text or b"").translate(_LOWER).split()
                words += own
                rows.append(row)
                sizes.append(len(own))
                if len(words) > self.block // 2:
                    yield self._block(words, np.repeat(rows, sizes))
                    words, rows, sizes = [], [], []
                continue
            last: list[bytes] = []
            for own in word_lists(text, _LOWER, PIECE):
                if own:  # the last word goes on into the next piece's first pair, but counts once
                    yield self._block(last + own, np.full(len(last) + len(own), row), skip_first=bool(last))
                    last = own[-1:]
        if words:
            yield self._block(words, np.repeat(rows, sizes))

    def _block(self, words: list[bytes], rows: np.ndarray, skip_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = rows[1:] == rows[:-1]
        one, two = self.of_words(words, joined)
        first = rows[:-1][joined]
        if skip_first:
            one, rows = one[1:], rows[1:]
        return np.concatenate((rows, first)), np.concatenate((one, two)), rows


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the features of a column of binary texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(buckets, np.int64), Features(buckets)
        for batch in batches:
            for _, bucket, _ in found.of_texts(x.as_py() for x in batch.column(0)):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    with held(texts.sparkSession, arrow_rows(BATCH)):
        vectors = texts.mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
        return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) of each bucket."""
    n, big_t, big_s = len(target), float(target.sum()) + len(target), float(corpus.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * big_s / ((float(corpus[k]) + 1) * big_t))) for k in range(n)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, found = shared.value, Features(len(shared.value))
        for batch in batches:
            n = batch.num_rows
            words, features, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for row, bucket, of_word in found.of_texts(x.as_py() for x in batch.column(1)):
                words += np.bincount(of_word, minlength=n)
                features += np.bincount(row, minlength=n)
                sums += np.bincount(row, gains[bucket], n)  # whole numbers, exact in doubles
            weight = np.floor_divide(sums.astype(np.int64), np.maximum(features, 1))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_words": pa.array(words), "n_features": pa.array(features), "weight": pa.array(weight)})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, *, percent: int, least_words: int, seed: int) -> DataFrame:
    """Adds score, and the rank of each of the floor(percent * N / 100) drawn ones among the N of ``least_words`` words."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    work = Workspace(weighed.sparkSession, "resampling", BATCH)
    scored = work.save(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = F.col("n_words") >= least_words
    seen = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).toArrow()  # a row a score: bounded by the gains' range
    score, n = seen.column("score").to_numpy(), seen.column("n").to_numpy()
    order = np.argsort(-score)
    score, above = score[order], np.cumsum(n[order]) - n[order]
    many = int(n.sum()) * percent // 100
    score, above = score[above < many], above[above < many]
    firsts = scored.sparkSession.createDataFrame(pa.table({"score": pa.array(score, pa.int64()), "above": pa.array(above, pa.int64())}))
    row = ["id", "n_words", "n_features", "weight", "score"]
    # rows alike are numbered together, one row for each task that holds some, so that no score is a hot key
    alike = scored.filter(able).withColumn("task", F.spark_partition_id()).join(F.broadcast(firsts), "score").groupBy(*row, "above", "task").agg(F.count("*").alias("n"))
    within = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "n_words", "task")
    to = alike.withColumn("to", F.col("above") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    best = to.withColumn("rank", F.explode(F.sequence(F.col("to") - F.col("n") + 1, F.col("to")))).withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    lowest = int(score[-1]) if many else None
    rest = scored.filter(~able | (F.lit(True) if lowest is None else F.col("score") < lowest)).withColumn("rank", F.lit(None).cast("long"))
    return best.select(*row, "rank").unionByName(rest.select(*row, "rank"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank (null where not drawn) of every row of ``docs``."""
    need(docs, id_col, text_col)
    need(target, target_col)
    as_bytes = lambda df, c: df.select(F.col(c).cast("binary").alias("text"))
    gains = bucket_gains(bucket_counts(as_bytes(target, target_col), buckets), bucket_counts(as_bytes(docs, text_col), buckets))
    drawn = draw(weigh(docs, gains, id_col=id_col, text_col=text_col), percent=percent, least_words=least_words, seed=seed)
    return drawn.withColumnRenamed("id", id_col)
