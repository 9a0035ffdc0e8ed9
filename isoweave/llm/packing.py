"""Packing of tokenized documents into sequences of at most ``capacity`` tokens.

Documents over the capacity are cut into pieces of the capacity; the last piece
may be shorter.  How pieces share sequences is planned on the histogram of
piece lengths alone, so the plan's size depends on the capacity and not on the
number of pieces:

1. Lengths fall into ``UNITS`` equal bins.  All patterns of at most ``PARTS``
   bins that fill a sequence are enumerated, and non-negative least squares
   fits their repeat counts to the histogram; a miss of a long bin weighs more
   than one of a short bin, since short pieces still find room later.
2. The counts are rounded down, and each pattern is drawn from the real
   lengths: the longest left of each bin, the last part by best fit, then the
   room that is left is filled by best fit.  Equal draws repeat as one run.
3. The residual pieces are packed by best fit, longest first.

A run says "these lengths, n times".  Each piece has a rank among the pieces of
its length (from counts per task and length, never from a sort of one length),
and the rank finds its run, hence its sequence and its place there.

Defined cases: null text is empty, and an empty text is the end id alone; rows
with the same id are packed as different documents; a null id stays null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need
from isoweave.llm.encode import encoder, word_bpe

UNITS, PARTS = 32, 5
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces, each with its task and its number among the task's pieces of the same length."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        for batch in batches:
            rows = []
            for i, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    length = len(part) // 4
                    rows.append((i, k, at, length, zlib.crc32(part), task, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(cut, PIECE)


def patterns(units: int = UNITS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All multisets of at most ``parts`` bins that add up to ``units``, largest bin first."""
    found: list[tuple[int, ...]] = []

    def extend(have: tuple[int, ...], left: int, most: int) -> None:
        if not left:
            found.append(have)
        elif len(have) < parts:
            for b in range(min(left, most), 0, -1):
                extend((*have, b), left - b, b)

    extend((), units, units)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 with the least ||ax - b||, by an active set of columns (Lawson and Hanson)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = np.where(active, -np.inf, a.T @ (b - a @ x))
        j = int(w.argmax())
        if w[j] <= tol:
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 1e-12)
            if not low.any():
                x = s
                break
            step = np.where(low & (x > s), x / np.where(x > s, x - s, 1), np.inf)
            x = x + min(1.0, float(step.min())) * (s - x)
            x[low & (x <= 1e-12)] = 0
            active &= x > 1e-12
    return x


class _Stock:
    """How many pieces of each length are left, with the best fit for a room."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(object).tolist()
        self.mask = sum(1 << k for k, c in enumerate(self.n) if c)

    def best(self, room: int, taken: dict[int, int], least: int = 1) -> int:
        """The longest length of ``least`` to ``room`` that is left besides what is taken; 0 if none."""
        mask = self.mask & ((1 << (room + 1)) - 1) if room >= least else 0
        while mask:
            k = mask.bit_length() - 1
            if k < least:
                return 0
            if self.n[k] > taken.get(k, 0):
                return k
            mask ^= 1 << k
        return 0

    def take(self, lengths: list[int], times: int) -> None:
        for k in lengths:
            self.n[k] -= times
            if not self.n[k]:
                self.mask &= ~(1 << k)


def plan(counts: np.ndarray, capacity: int, units: int = UNITS, parts: int = PARTS) -> list[tuple[list[int], int]]:
    """Runs (lengths of one sequence, number of such sequences) that use up ``counts`` (by length)."""
    stock, runs = _Stock(counts), []

    def add(have: list[int], most: int) -> int:
        """Fill the room left by best fit, then repeat as often as the stock allows."""
        room, taken = capacity - sum(have), {}
        for k in have:
            taken[k] = taken.get(k, 0) + 1
        while k := stock.best(room, taken):
            have.append(k)
            taken[k] = taken.get(k, 0) + 1
            room -= k
        times = min(most, *(stock.n[k] // c for k, c in taken.items()))
        stock.take(have, times)
        runs.append((have, times))
        return times

    top = [-(-capacity * b // units) for b in range(units + 1)]  # the longest length of each bin
    bins = np.array([counts[top[b - 1] + 1 : top[b] + 1].sum() for b in range(1, units + 1)], float)
    shapes = patterns(units, parts)
    a = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for b in shape:
            a[b - 1, j] += 1
    weight = np.linspace(0.1, 1, units)
    fit = np.floor(nnls(a * weight[:, None], bins * weight) + 1e-6).astype(int)
    for j in sorted(np.flatnonzero(fit).tolist(), key=lambda j: shapes[j], reverse=True):
        left = int(fit[j])
        while left > 0:
            have, taken = [], {}
            for b in shapes[j][:-1]:
                k = stock.best(min(top[b], capacity - sum(have)), taken, top[b - 1] + 1)
                if not k:
                    break
                have.append(k)
                taken[k] = taken.get(k, 0) + 1
            if not have and len(shapes[j]) == 1 and (k := stock.best(top[shapes[j][0]], {}, top[shapes[j][0] - 1] + 1)):
                have = [k]
            if len(have) < max(1, len(shapes[j]) - 1):
                break  # the bins have run out; the residual takes the rest
            left -= add(have, left)
    while stock.mask:
        add([stock.best(capacity, {})], 1 << 62)
    return runs


def slots(runs: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Per run and part: length, the first rank it takes, the run's first sequence, the place there."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in runs:
        at = 0
        for k in lengths:
            rows.append((k, used.get(k, 0), sequence, at))
            used[k] = used.get(k, 0) + times
            at += k
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T.copy(), strict=True))


def pack(docs: DataFrame, *, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.save(pieces_of(docs, capacity, tokenizer or word_bpe(), end_id, id_col, text_col), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length, capacity at most
        counts[r.length] = r.n
    found = spark.sparkContext.broadcast(slots(plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = found.value
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length, rank = (cols.pop(n).to_numpy() for n in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            lo, hi = np.searchsorted(s["length"], length), np.searchsorted(s["length"], length, "right")
            for k in np.unique(length):
                own = length == k
                a, b = lo[own][0], hi[own][0]
                at[own] = a + np.searchsorted(s["rank"][a:b], rank[own], "right") - 1
            cols |= {"length": pa.array(length), "sequence_id": pa.array(s["sequence"][at] + rank - s["rank"][at]), "offset": pa.array(s["offset"][at])}
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=list(names))

    ranked = pieces.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    out = ranked.select("doc_id", "piece", "start", "ids_crc32", "length", "rank")
    return out.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
