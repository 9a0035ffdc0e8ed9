"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

Words are the white-space-separated parts of the lower-cased text.  A window of
a document has as many words as the item it is held against (the whole document
if that is shorter) and a multiset of five-word shingles (an item of fewer
words is one shingle).  The similarity of window and item is the weighted
Jaccard index of those multisets: shared counts over united counts.

1. Where a window can match at all.  A similarity of 0.8 takes at least 0.8
   times the item's shingles in common, so a window with fewer places whose
   shingle stands in any item of the benchmark is passed over.  That filter
   loses nothing and names no item.
2. Each other window gets a SimHash of its words, ``BITS`` bits (words, since an
   edited word changes five shingles, but one word).  The items' fingerprints
   stand in ``BLOCKS`` hash tables, one per block of ``BLOCK_BITS`` bits: two
   fingerprints within ``RADIUS`` differ by at most RADIUS // BLOCKS bits in some
   block, so an item is kept under every value so close to its own, and one look
   into each table finds all items within the radius, with certainty.  Of random
   pairs of fingerprints 2.6 % meet in a table.
3. Those within the radius are verified exactly.

The radius is the only loss: where a tenth of a window's words differ, about 18
bits do, with a deviation of 4, so one such window in a hundred lies beyond 27.

The benchmark is taken in blocks of about ``BLOCK_WORDS`` words, an item counting
``ITEM_WORDS`` more than it has, each of which is broadcast and scans all
documents.  Items stay whole, so a longer one makes its block as long.

Defined cases: null or empty documents and items match nothing; items of equal
words are scanned as one and reported under each of their ids, a null id as
null; a row is scanned as often as it occurs; null ids are kept; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import need

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, RADIUS = 7, 18, 27
BITS = BLOCKS * BLOCK_BITS
BLOCK_WORDS, ITEM_WORDS = 100_000, 40
#: Windows that are fingerprinted at once.
_WINDOWS = 8192
_FILTER_BITS = 20
_MULT = np.int64(-7046029254386353131)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(words: list[str], width: int) -> list[str]:
    return [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]


def similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (a.total() + b.total() - shared) if shared else 0.0


@functools.lru_cache(maxsize=1 << 16)
def _digest(word: str) -> bytes:
    return xxhash.xxh3_128_digest(word)


def _signs(words: list[str]) -> np.ndarray:
    """Per word BITS numbers, each -1 or 1, from its hash."""
    raw = b"".join(map(_digest, words))
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1, count=BITS)
    return 2 * bits.astype(np.int32) - 1


def fingerprints(signs: np.ndarray, count: int) -> np.ndarray:
    """SimHash, as bytes, of each run of ``count`` words."""
    total = np.vstack((np.zeros((1, BITS), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)))
    return np.packbits(total[count:] - total[:-count] > 0, axis=1)


@functools.cache
def _near_values(within: int) -> np.ndarray:
    """The values of a block that differ from 0 in so many bits at most."""
    v = np.arange(1 << BLOCK_BITS)
    return v[np.bitwise_count(v) <= within]


def _blocks(prints: np.ndarray) -> np.ndarray:
    """The value of each block, shape (prints, BLOCKS)."""
    bits = np.unpackbits(prints, axis=1, count=BITS).reshape(len(prints), BLOCKS, BLOCK_BITS)
    return bits @ (1 << np.arange(BLOCK_BITS))


class HammingIndex:
    """Items' fingerprints under a multi-index: per block a table from its values to the items so close."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.tables = prints, radius, []
        near = _near_values(radius // BLOCKS)
        for values in _blocks(prints).T:
            keys = (values[:, None] ^ near).ravel().astype(np.int32)
            items = (np.argsort(keys, kind="stable") // len(near)).astype(np.int32)
            starts = np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=1 << BLOCK_BITS))))
            self.tables.append((starts, items))

    def met(self, query: np.ndarray) -> np.ndarray:
        """query * items + item of every pair that meets in a table, each once."""
        found = []
        for values, (starts, items) in zip(_blocks(query).T, self.tables, strict=True):
            first, many = starts[values], starts[values + 1] - starts[values]
            q = np.repeat(np.arange(len(query)), many)
            at = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            found.append(q * len(self.prints) + items[at])
        return np.unique(np.concatenate(found))

    def within(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of every pair within the radius."""
        q, i = np.divmod(self.met(query), len(self.prints))
        close = np.bitwise_count(query[q] ^ self.prints[i]).sum(1) <= self.radius
        return q[close], i[close]


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` word hashes."""
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out = out * _MULT + h[k : k + n]
        return out ^ (out >> np.int64(29))


class ItemBlock:
    """Items ready for scanning; built once in each Python worker, whose word hashes it uses."""

    def __init__(self, items: list[tuple[list[int | None], list[str]]]):
        self.items = items
        self.width = np.array([min(SHINGLE, len(w)) for _, w in items])
        self.size = np.array([len(w) for _, w in items])
        self.bags = [Counter(shingles(w, k)) for (_, w), k in zip(items, self.width.tolist(), strict=True)]
        self.index = HammingIndex(np.vstack([fingerprints(_signs(w), len(w)) for _, w in items]))
        self.shapes: dict[int, list[int]] = {}  # shingle width: sizes of the items that have it
        self.held: dict[int, np.ndarray] = {}  # shingle width: sorted hashes of all their shingles
        self.filters = {}
        for k in sorted(set(self.width.tolist())):
            own = np.flatnonzero(self.width == k).tolist()
            self.shapes[k] = sorted(set(self.size[own].tolist()))
            self.held[k] = np.unique(np.concatenate([_rolled(self.hashes(items[i][1]), k) for i in own]))
            self.filters[k] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[k][self.held[k] & ((1 << _FILTER_BITS) - 1)] = True

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words))

    def _held_places(self, h: np.ndarray, k: int) -> np.ndarray:
        """The places of a text where a shingle of any item stands."""
        rolled = _rolled(h, k)
        at = np.flatnonzero(self.filters[k][rolled & ((1 << _FILTER_BITS) - 1)])
        place = np.searchsorted(self.held[k], rolled[at]) % len(self.held[k])
        return at[self.held[k][place] == rolled[at]]

    def _windows(self, h: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(shingle width, item size, starts) of all windows that may match."""
        n = len(h)
        for k, sizes in self.shapes.items():
            at = self._held_places(h, k) if n >= k else ()
            if not len(at):
                continue
            for size in sizes:
                least = math.ceil(SIMILARITY * (size - k + 1) - 1e-9)
                places = min(size, n) - k + 1
                if len(at) < least or places < least:
                    continue
                lo, hi = max(0, int(at[0]) - places + 1), min(int(at[-1]), n - k + 1 - places)
                hit = np.zeros(hi + places - lo + 1, np.int32)
                hit[at[(at >= lo) & (at < hi + places)] - lo + 1] = 1
                total = np.cumsum(hit)
                found = lo + np.flatnonzero(total[places:] - total[:-places] >= least)
                if len(found):
                    yield k, size, found

    def matches(self, text: str | None) -> list[tuple[list[int | None], float, int]]:
        """(item ids, similarity, first word) of the best window for each item that reaches SIMILARITY."""
        words = words_of(text)
        best: dict[int, tuple[float, int]] = {}
        for k, size, at in self._windows(self.hashes(words)):
            count = min(size, len(words))
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                for a in range(0, len(run), _WINDOWS):
                    first, last = int(run[a]), int(run[min(a + _WINDOWS, len(run)) - 1]) + count
                    for q, i in zip(*self.index.within(fingerprints(_signs(words[first:last]), count)), strict=True):
                        if self.size[i] == size:
                            start = first + int(q)
                            value = similarity(Counter(shingles(words[start : start + count], k)), self.bags[i])
                            if value >= SIMILARITY and value > best.get(int(i), (0.0, 0))[0]:
                                best[int(i)] = (value, start)
        return [(self.items[i][0], value, start) for i, (value, start) in sorted(best.items())]


_BUILT: dict[int, ItemBlock] = {}


def _block(shared) -> ItemBlock:
    if shared.id not in _BUILT:
        _BUILT.clear()
        _BUILT[shared.id] = ItemBlock(shared.value)
    return _BUILT[shared.id]


class _Shared:
    """A broadcast with a name of its own for the worker's cache."""

    def __init__(self, broadcast):
        import uuid

        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def item_blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[_Shared]:
    """The items, as broadcasts of about ``block_words`` words each; a block is collected when its turn comes."""
    need(benchmark, item_col, item_text_col)
    words = F.filter(F.split(F.lower(F.col(item_text_col).cast("string")), r"\s+"), lambda w: w != "")
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.array_join(words, " ").alias("text"), F.size(words).cast("long").alias("n"))
    items = items.filter("n > 0")
    total = items.agg(F.sum(F.col("n") + ITEM_WORDS)).first()[0] or 0
    n_blocks = -(-total // block_words)
    for b in range(n_blocks):
        by_words: dict[tuple[str, ...], set[int | None]] = {}
        for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).collect():
            key = tuple(words_of(r.text))
            if key:
                by_words.setdefault(key, set()).add(r.item)
        if by_words:
            yield _Shared(benchmark.sparkSession.sparkContext.broadcast([(sorted(i, key=lambda x: (x is None, x or 0)), list(w)) for w, i in sorted(by_words.items())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id_col, item_col, similarity, start): per document and item its best window, if similar enough."""
    need(docs, id_col, text_col)
    schema = f"`{id_col}` long, `{item_col}` long, similarity double, start long"
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in item_blocks(benchmark, item_col, item_text_col, block_words):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = _block(shared)
            for batch in batches:
                rows = [(i, item, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for items, *m in block.matches(text) for item in items]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip((id_col, item_col, "similarity", "start"), cols, kinds, strict=True)})

        found = src.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows whose text matches no item, with all their columns; nothing is shuffled."""
    need(docs, text_col)
    for shared in item_blocks(benchmark, item_col, item_text_col, block_words):

        @F.pandas_udf("boolean")
        def clean(text, shared=shared):
            block = _block(shared)
            return text.map(lambda t: not block.matches(t))

        docs = docs.filter(clean(F.col(text_col).cast("string")))
    return docs
