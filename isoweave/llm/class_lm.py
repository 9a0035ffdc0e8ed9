"""Brown class-based bigrams: exchange clustering of words, and smoothed scores of texts.

Tokens are the parts between ASCII white space of the text with A-Z in lower
case, and one end per text, which also stands before the first token.

Training, over all texts of the training part:
1. Counts of all words, by a partial count in each task and one shuffle.
2. The start: the ``FREQUENT`` most frequent words are units each for itself,
   every other word goes by the shape of its spelling (``SHAPES`` hashed shapes).
   Counts of unit bigrams, at most (FREQUENT + SHAPES) squared numbers.
3. Exchange: units start dealt out over ``CLASSES`` classes by frequency; each
   in turn moves to the class where the likelihood of the class bigrams is
   greatest, until a sweep moves none.  That settles the frequent words.
4. One exchange step for every other word of the count table: over all texts it
   is counted with the classes before and behind it (one shuffle on the word, the
   sums taken as the sorted rows pass) and moves to the class where the
   likelihood of the class bigrams is greatest, its own tokens left out of its old
   class.  All move at once.  Words move among the classes in use.  Only words
   that training never saw keep the class of their spelling.
Then P(w | v) = P(class w | class v) * P(w | class w).  Transitions are counted
over the final classes of all tokens and smoothed towards the classes' own
shares, emissions as (c + 0.5) / (N + 0.5 (V + 1)) with the class's tokens N and
distinct words V.

Texts are encoded once: the most frequent words (``LOCAL_WORDS`` at most, of at
most ``LOCAL_WORD_BYTES`` each, a broadcast of proven size) as numbers.  The rest
of a text's words stand beside it and meet their classes and counts in a join on
the word, which returns to the text; what is kept then is one byte for the class
of each token, and the text's sums.  No count is capped or sampled.

Defined cases: null text is empty, and an empty text is one end; a null id
counts as the empty id text when it is dealt to a part; rows with one id are
scored each; extra columns are ignored; without training texts N and V are 0.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need

FREQUENT, SHAPES, CLASSES = 1000, 256, 64  # classes: 256 at most, one byte each
LOCAL_WORDS, LOCAL_WORD_BYTES = 200_000, 64
SMOOTH = 20.0
END = b""
_FLUSH = 300_000
_ROWS_A_BATCH, _PIECE, _BLOCK, _ENTRIES = 2000, 1_000_000, 256, 4_000_000
_KIND = re.compile(rb"[a-z]+")


def tokens_of(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _shape(word: bytes) -> int:
    beyond = bytes(sorted({b for b in word if b >= 0xC0})) + bytes(sorted({b for b in word if 0x80 <= b < 0xC0}))[:2]
    marks = _KIND.sub(b"", bytes(b for b in word if b < 0x80))
    marks = re.sub(rb"[0-9]+", b"0", marks)[-3:]
    band = b"%d" % min(4, len(word) // 3)
    return zlib.crc32(b"|".join((beyond, marks, band))) % SHAPES


_short_shape = functools.lru_cache(maxsize=1 << 17)(_shape)


def shape_of(word: bytes) -> int:
    """A unit for a word by its spelling: marks and digits it holds, its accents, its length band."""
    return (_short_shape if len(word) <= LOCAL_WORD_BYTES else _shape)(word)


def exchange(bigrams: np.ndarray, classes: int, moves: Callable | None = None) -> np.ndarray:
    """The class of each unit, from the unit bigram counts; ends with the sweep that moves none.

    A gain is the change of ``likelihood`` that the move makes.  It must be more than
    rounding can give, so that the likelihood rises with each move and the sweeps end.
    ``moves`` is told of each: the unit, its old class and new one, the gain, all classes.
    """

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    u = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    cls = np.empty(u, np.int64)
    cls[order] = np.arange(u) % classes
    onehot = np.eye(classes)[cls]
    n = onehot.T @ bigrams @ onehot
    at = np.arange(classes)
    least_gain = 1e-9 * max(bigrams.sum(), 1.0)
    while True:
        moved = 0
        for w in order.tolist():
            a, self_ = cls[w], bigrams[w, w]
            row, col = np.bincount(cls, bigrams[w], classes), np.bincount(cls, bigrams[:, w], classes)
            if not row.any() and not col.any():
                continue
            row[a] -= self_
            col[a] -= self_
            n[a] -= row
            n[:, a] -= col
            n[a, a] -= self_
            fn = f(n)
            plus_row, plus_col = f(n + row) - fn, f(n + col[:, None]) - fn
            gain = plus_row.sum(1) - plus_row[at, at] + plus_col.sum(0) - plus_col[at, at]
            gain += f(n[at, at] + row + col + self_) - fn[at, at]
            out, into = n.sum(1) + col, n.sum(0) + row  # a class's totals hold its tokens beside this one too
            gain -= f(out + row.sum() + self_) - f(out) + f(into + col.sum() + self_) - f(into)
            b = int(gain.argmax()) if gain.max() > gain[a] + least_gain else int(a)
            moved += b != a
            cls[w] = b
            if moves and b != a:
                moves(w, a, b, gain[b] - gain[a], cls)
            n[b] += row
            n[:, b] += col
            n[b, b] += self_
        if not moved:
            return cls


class Labels:
    """The class of every local word by its number, and of any other by its spelling, until it is classed itself."""

    def __init__(self, local: list[tuple[bytes, int]], frequent: int, cls: np.ndarray, classes: int):
        self.words = [w for w, _ in local]
        self.n_frequent, self.classes = min(frequent, len(local)), classes
        self.of_unit = cls
        spelled = [cls[self.n_frequent + shape_of(w)] for w in self.words[self.n_frequent :]]
        self.of_local = np.concatenate((cls[: self.n_frequent], np.array(spelled, np.int64)))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens_of(text))
            if len(counts) > _FLUSH:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a column of binary texts."""
    return texts.mapInArrow(_partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """Words of the highest counts, ``most`` at most, in order: by a threshold that a histogram of counts gives."""
    step = F.floor(F.log2("n") * 16).cast("int")
    short = counts.filter(F.octet_length("word") <= most_bytes)
    have = sorted(((r.bin, r.words) for r in short.groupBy(step.alias("bin")).agg(F.count("*").alias("words")).collect()), reverse=True)
    total, least = 0, None
    for b, words in have:
        if total + words > most:
            break
        total, least = total + words, b
    if least is None:
        return []
    rows = short.filter(step >= least).toArrow()
    return sorted(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


_ROWS = "task int, nth long, id long, held_out boolean, ids array<int>, rare array<binary>, unit array<int>"


def _lists(flat: list, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, kind))


def _encode(docs: DataFrame, local: list[tuple[bytes, int]], frequent: int, id_col: str, text_col: str, held_out: str) -> DataFrame:
    """Texts as numbers: a local word by its place, any other by -1 - k with k its place in the row's ``rare``; ``unit``: theirs by spelling."""
    shared, cache = docs.sparkSession.sparkContext.broadcast([w for w, _ in local]), {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.update({w: k for k, w in enumerate(shared.value)})
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS_A_BATCH):
                part = batch.slice(first, _ROWS_A_BATCH)
                ids, rare, many = [], [], []
                for text in part.column("text").to_pylist():
                    words = tokens_of(text)
                    row = list(map(cache.get, words))
                    others: dict[bytes, int] = {}
                    if None in row:
                        row = [-1 - others.setdefault(w, len(others)) if k is None else k for k, w in zip(row, words, strict=True)]
                    ids.append(np.array(row, np.int32))
                    rare += others
                    many.append(len(others))
                n = part.num_rows
                yield pa.RecordBatch.from_pydict({
                    "task": pa.array([task] * n, pa.int32()), "nth": pa.array(range(nth, nth + n), pa.int64()), "id": part.column("id"), "held_out": part.column("held_out"),
                    "ids": pa.array(ids, pa.list_(pa.int32())), "rare": _lists(rare, many, pa.binary()), "unit": _lists([frequent + shape_of(w) for w in rare], many, pa.int32()),
                })
                nth += n

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.expr(held_out).alias("held_out"))
    return src.mapInArrow(run, _ROWS)


class _Flat:
    """The tokens of some encoded rows, end to end; in each row the end stands before the first word too."""

    def __init__(self, batch: pa.RecordBatch, n_local: int):
        ids, rare = batch.column("ids"), batch.column("rare")
        size = ids.value_lengths().to_numpy(zero_copy_only=False)
        self.starts = np.cumsum(size) - size
        self.ends, self.size = self.starts + size - 1, size
        self.rare, self.unit = rare.flatten(), batch.column("unit").flatten().to_numpy(zero_copy_only=False)
        self.many = rare.value_lengths().to_numpy(zero_copy_only=False)
        at = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.where(at < 0, n_local - 1 - at + np.repeat(np.cumsum(self.many) - self.many, size), at)  # past n_local: a place in rare

    def before(self, x: np.ndarray) -> np.ndarray:
        out = np.roll(x, 1)
        out[self.starts] = x[self.ends]
        return out

    def after(self, x: np.ndarray) -> np.ndarray:
        out = np.roll(x, -1)
        out[self.ends] = x[self.starts]
        return out


def _pieces(batches: Iterator[pa.RecordBatch], n_local: int) -> Iterator[tuple[pa.RecordBatch, _Flat]]:
    """Encoded rows, about ``_PIECE`` tokens at a time (a row stays whole)."""
    for batch in batches:
        size = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
        first = 0
        while first < batch.num_rows:
            done = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, done + _PIECE, "right")))
            part = batch.slice(first, last - first)
            yield part, _Flat(part, n_local)
            first = last


def _square(bigrams: DataFrame, n: int) -> np.ndarray:
    """The n * n counts of (pair, n), a pair being n * (the one before) + (the one behind)."""
    got = bigrams.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # n * n rows at most
    out = np.zeros(n * n)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(n, n)


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(counts[at])})


def _unit_bigrams(rows: DataFrame, unit: np.ndarray, n: int) -> np.ndarray:
    """How often a token of one unit follows one of another; ``unit`` holds those of the local words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n * n, np.int64)
        for _, flat in _pieces(batches, len(unit)):
            x = np.concatenate((unit, flat.unit.astype(np.int64)))[flat.at]
            pairs, times = np.unique(flat.before(x) * n + x, return_counts=True)
            counts[pairs] += times
        yield _counted(counts)

    return _square(rows.select("ids", "rare", "unit").mapInArrow(run, "pair long, n long"), n)


def likelihood(n: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes: of their bigrams, against their totals on both sides."""
    f = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def _blobs(keys: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, pa.Array]:
    """The owners key // width of sorted keys, and per owner its places key % width, each above 40 bits of count, as bytes."""
    owners, start = np.unique(keys // width, return_index=True)
    packed = (keys % width << 40) | times
    offsets = (np.append(start, len(keys)) * 8).astype(np.int32)
    return owners, pa.Array.from_buffers(pa.binary(), len(owners), [None, pa.py_buffer(offsets), pa.py_buffer(packed.astype("<i8"))])


def _contexts(rows: DataFrame, labels: Labels) -> DataFrame:
    """(word, seen) of every word but the frequent ones: how often each class stands before and behind it.

    A place in ``seen`` is the class before, or ``classes`` + the class behind.
    Local words go in blocks of ``_BLOCK``, named by a blank, which no word holds,
    and the block's number; there the place of a word's n-th place is n + 2 *
    ``classes`` * its place in the block.
    """
    shared = rows.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        n_local, wide = len(labels.words), 2 * labels.classes
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def local_blocks() -> pa.RecordBatch:
            blocks, seen = _blobs(keys, times, wide * _BLOCK)
            return pa.RecordBatch.from_pydict({"word": pa.array([b" %d" % b for b in blocks.tolist()], pa.binary()), "seen": seen})

        for _, flat in _pieces(batches, n_local):
            cls = np.concatenate((labels.of_local, labels.of_unit[flat.unit]))[flat.at]
            before, after = flat.before(cls), labels.classes + flat.after(cls)
            here = np.flatnonzero((flat.at >= labels.n_frequent) & (flat.at < n_local))
            own = flat.at[here] * wide
            more, n = np.unique(np.concatenate((own + before[here], own + after[here])), return_counts=True)
            keys, back = np.unique(np.concatenate((keys, more)), return_inverse=True)
            times = np.bincount(back, np.concatenate((times, n)), len(keys)).astype(np.int64)
            if len(keys) > _ENTRIES:
                yield local_blocks()
                keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            here = np.flatnonzero(flat.at >= n_local)
            if not len(here):
                continue
            rare = flat.rare.dictionary_encode()
            own = rare.indices.to_numpy(zero_copy_only=False)[flat.at[here] - n_local].astype(np.int64) * wide
            words, seen = _blobs(*np.unique(np.concatenate((own + before[here], own + after[here])), return_counts=True), wide)
            names = rare.dictionary.cast(pa.binary()).take(pa.array(words))
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_pydict({"word": names[a : a + 50_000], "seen": seen[a : a + 50_000]})
        yield local_blocks()

    return rows.select("ids", "rare", "unit").mapInArrow(run, "word binary, seen binary")


def best_classes(seen: np.ndarray, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per word the class of the greatest likelihood, the bigrams ``n`` of all other tokens being as they are.

    ``seen`` counts the classes before the word and then those behind it; a word's own tokens don't speak for its class.
    """
    k = len(n)
    before, behind = seen[:, :k], seen[:, k:]
    own = seen[:, :k].sum(1)
    log, total = np.log(n + 0.5), n.sum(1)
    gain = before @ log + behind @ log.T - 2 * own[:, None] * np.log(total + 0.5)
    there = (before * np.log(np.maximum(n[:, cls].T - before, 0) + 0.5)).sum(1) + (behind * np.log(np.maximum(n[cls] - behind, 0) + 0.5)).sum(1)
    at = np.arange(len(cls))
    gain[at, cls] = there - 2 * own * np.log(np.maximum(total[cls] - own, 0) + 0.5)
    gain = np.round(gain, 6)
    best = gain.argmax(1)
    return np.where(gain[at, best] > gain[at, cls], best, cls)


def _moved(contexts: DataFrame, labels: Labels, n: np.ndarray) -> DataFrame:
    """(word, place, n, cls): every word with its count and its best class; ``place`` among the local words, or -1.

    A task reads its rows in the order of the word and keeps the sums of one word (or block) only.
    """
    shared = contexts.sparkSession.sparkContext.broadcast((labels, n))
    wide = 2 * len(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, n = shared.value

        def out(words: list[bytes], places: np.ndarray, seen: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "place": pa.array(places, pa.int32()), "n": pa.array(seen[:, : len(n)].sum(1).astype(np.int64)), "cls": pa.array(best_classes(seen, cls, n), pa.int32())})

        def rare(words: list[bytes], seen: np.ndarray) -> pa.RecordBatch:
            return out(words, np.full(len(words), -1), seen, labels.of_unit[[labels.n_frequent + shape_of(w) for w in words]].astype(np.int64))

        def block(name: bytes, sums: np.ndarray) -> pa.RecordBatch:
            first = int(name) * _BLOCK
            sums = sums.reshape(_BLOCK, wide)
            held = np.flatnonzero(sums[:, : len(n)].sum(1))
            return out([labels.words[k] for k in first + held], first + held, sums[held], labels.of_local[first + held])

        name, sums = None, None  # the word that goes on in the next rows
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                words, blobs = part.column("word").to_pylist(), part.column("seen")
                size = pa.compute.binary_length(blobs).to_numpy(zero_copy_only=False) // 8
                packed = np.frombuffer(b"".join(blobs.to_pylist()), "<i8")
                at, times, ends = packed >> 40, packed & ((1 << 40) - 1), np.cumsum(size)
                starts = [k for k in range(len(words)) if k == 0 or words[k] != words[k - 1]] + [len(words)]
                plain: list[tuple[int, int]] = []  # runs of rare words that begin and end here
                for first, last in zip(starts, starts[1:]):
                    w, lo, hi = words[first], ends[first] - size[first], ends[last - 1]
                    if w == name or last == len(words) or w[:1] == b" ":
                        own = np.bincount(at[lo:hi], times[lo:hi], wide * (_BLOCK if w[:1] == b" " else 1))
                        if w == name:
                            sums += own
                            continue
                        if name is not None:
                            yield block(name, sums) if name[:1] == b" " else rare([name], sums[None, :])
                        name, sums = w, own
                    else:
                        plain.append((first, last))
                if plain:
                    nth = np.concatenate([np.full(ends[y - 1] - ends[x] + size[x], k) for k, (x, y) in enumerate(plain)])
                    own = np.concatenate([np.arange(ends[x] - size[x], ends[y - 1]) for x, y in plain])
                    yield rare([words[x] for x, _ in plain], np.bincount(nth * wide + at[own], times[own], len(plain) * wide).reshape(-1, wide))
        if name is not None:
            yield block(name, sums) if name[:1] == b" " else rare([name], sums[None, :])

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word binary, place int, n long, cls int")


_CLASSED = "id long, held_out boolean, n_tokens long, n_known long, base_score double, own double, classes binary"


def _classed(rows: DataFrame, words: DataFrame, labels: Labels, local_n: np.ndarray, base_total: float) -> DataFrame:
    """Per row its class sequence, base score and ``own``, the sum of log10(count + 0.5) of its tokens; an unseen word goes by its spelling."""
    key = ["task", "nth"]
    met = rows.select(*key, F.posexplode("rare").alias("k", "word")).join(words.filter("place < 0").select("word", "n", "cls"), "word")
    back = met.groupBy(*key).agg(F.collect_list(F.struct("k", "cls", "n")).alias("known"))  # a text's words at most
    shared = rows.sparkSession.sparkContext.broadcast((labels, local_n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, local_n = shared.value
        for part, flat in _pieces(batches, len(local_n)):
            cls, n = labels.of_unit[flat.unit].astype(np.int64), np.zeros(len(flat.unit), np.int64)
            lists = part.column("known")
            known = lists.flatten()
            of_row = np.repeat(np.cumsum(flat.many) - flat.many, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = of_row + known.field("k").to_numpy(zero_copy_only=False)
            cls[at], n[at] = known.field("cls").to_numpy(zero_copy_only=False), known.field("n").to_numpy(zero_copy_only=False)
            cls, n = np.concatenate((labels.of_local, cls))[flat.at], np.concatenate((local_n, n))
            log = np.log10(n + 0.5)[flat.at]
            sums = np.add.reduceat(log, flat.starts)
            offsets = np.append(flat.starts, flat.ends[-1] + 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "id": part.column("id"), "held_out": part.column("held_out"), "n_tokens": pa.array(flat.size.astype(np.int64)), "n_known": pa.array(np.add.reduceat((n > 0)[flat.at].astype(np.int64), flat.starts)),
                "base_score": pa.array(sums - flat.size * np.log10(base_total)), "own": pa.array(sums),
                "classes": pa.Array.from_buffers(pa.binary(), len(flat.starts), [None, pa.py_buffer(offsets), pa.py_buffer(cls.astype(np.uint8))]),
            })

    joined = rows.join(back, key, "left").select("id", "held_out", "ids", "rare", "unit", "known")
    return joined.mapInArrow(run, _CLASSED)


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of all tokens, those before them, and where each row starts."""
    column = batch.column("classes")
    size = pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    cls = np.frombuffer(b"".join(column.to_pylist()), np.uint8).astype(np.int64)
    starts = np.cumsum(size) - size
    before = np.roll(cls, 1)
    before[starts] = cls[starts + size - 1]
    return cls, before, starts


def _class_bigrams(rows: DataFrame, k: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(k * k, np.int64)
        for batch in batches:
            if batch.num_rows:
                cls, before, _ = _sequences(batch)
                counts += np.bincount(before * k + cls, minlength=k * k)
        yield _counted(counts)

    return _square(rows.select("classes").mapInArrow(run, "pair long, n long"), k)


class ClassModel:
    """Class transitions, and what words cost within their class."""

    def __init__(self, n: np.ndarray, n_tokens: int, n_words: int, class_tokens: np.ndarray, class_words: np.ndarray):
        share = (n.sum(0) + 1) / (n.sum() + len(n))
        self.transition = np.log10((n + SMOOTH * share) / (n.sum(1, keepdims=True) + SMOOTH))
        self.n_tokens, self.n_words = n_tokens, n_words
        self.class_total = class_tokens + 0.5 * (class_words + 1)


def fit(docs: DataFrame, work: Workspace, *, held_out: str, classes: int, frequent: int, id_col: str, text_col: str) -> tuple[ClassModel, DataFrame, DataFrame, np.ndarray, list[tuple[bytes, int]]]:
    """The model, all rows with their class sequences, the classes of all but the frequent words, those of the local words, and the local words with their counts."""
    train = docs.filter(f"not ({held_out})").select(F.col(text_col).cast("binary").alias("text"))
    counts = work.save(word_counts(train), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_tokens, n_words = totals.n or 0, totals.v or 0
    local = frequent_words(counts, LOCAL_WORDS, LOCAL_WORD_BYTES)
    work.drop("counts")
    local_n, top = np.array([c for _, c in local], np.int64), min(frequent, len(local))
    rows = work.save(_encode(docs, local, top, id_col, text_col, held_out), "encoded")
    trained = rows.filter("not held_out")
    unit = np.concatenate((np.arange(top), np.array([top + shape_of(w) for w, _ in local[top:]], np.int64)))
    bigrams = _unit_bigrams(trained, unit, top + SHAPES)
    cls = exchange(bigrams, classes)
    labels = Labels(local, top, cls, classes)
    onehot = np.eye(classes)[cls]
    words = work.save(_moved(_contexts(trained, labels), labels, onehot.T @ bigrams @ onehot), "words")
    near = words.filter("place >= 0").select("place", "cls").toArrow()  # LOCAL_WORDS at most
    labels.of_local[near.column("place").to_numpy()] = near.column("cls").to_numpy()
    classed = work.save(_classed(rows, words, labels, local_n, n_tokens + 0.5 * (n_words + 1)), "classed")
    work.drop("encoded")
    n = _class_bigrams(classed.filter("not held_out"), classes)
    tokens, distinct = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("cls").agg(F.sum("n").alias("t"), F.count("*").alias("w")).collect():
        tokens[r.cls], distinct[r.cls] = r.t, r.w
    np.add.at(tokens, labels.of_local[:top], local_n[:top])
    np.add.at(distinct, labels.of_local[:top], 1)
    return ClassModel(n, n_tokens, n_words, tokens, distinct), classed, words, labels.of_local, local


def score_texts(docs: DataFrame, *, held_out: str = "false", classes: int = CLASSES, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where the SQL condition ``held_out`` is false, score all.

    Per row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.
    """
    need(docs, id_col, text_col)
    work = Workspace(docs.sparkSession, "class_lm")
    model, rows, *_ = fit(docs, work, held_out=held_out, classes=classes, frequent=frequent, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                cls, before, starts = _sequences(batch)
                steps = (m.transition - np.log10(m.class_total))[before, cls]
                score = batch.column("own").to_numpy() + np.add.reduceat(steps, starts)
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("id", "held_out", "n_tokens", "n_known", "base_score")} | {"score": pa.array(score)})

    out = rows.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
