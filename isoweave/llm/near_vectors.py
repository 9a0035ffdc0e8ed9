"""Near-duplicate vectors by cross-polytope hashing, with every link verified.

A hash rotates a vector pseudo-randomly (random signs and a fast Hadamard
transform, three times) and takes the nearest of the 2d signed axes; ``WIDTH``
hashes make a bucket's code and ``TABLES`` tables are independent.  Multiprobe:
in each table a vector is also put into the ``PROBES`` buckets got by taking
the second nearest axis of one hash, least certain hash first.

Vectors that are equal and have equal labels are one class and are hashed once.
Buckets with one member are dropped before any vector moves; large buckets are
cut into chunks, so that a task holds two chunks at most, and all pairs of
chunks are compared by matrix products in double precision.  A pair that meets
in several buckets counts only in the first table, and there at the smallest
code, where it does.  A block gives each class its number of new links and its
least linked member there, never pairs, so a group of copies costs time but
makes no more rows than it has members and buckets.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite
component, or whose label is null, links with nothing; so do vectors of
different lengths or labels; rows that repeat are vectors of their own and link
with each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need
from isoweave.llm.components import components

WIDTH, TABLES, PROBES, CHUNK = 3, 8, 3, 512
KEY = ["label", "dim", "bucket"]


def hadamard(a: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = a.shape
    h = 1
    while h < d:
        x = a.reshape(n, -1, 2, h)
        a = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(n, d)
        h *= 2
    return a


def buckets(v: np.ndarray, width: int = WIDTH, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Per row and table the codes of its buckets, shape (n, tables, 1 + probes)."""
    n, dim = v.shape
    d = max(2, 1 << (dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = v
    signs = np.random.default_rng([dim, width, tables]).choice([-1.0, 1.0], (tables, width, 3, d))
    rows, out = np.arange(n), np.empty((n, tables, 1 + min(probes, width)), np.int64)
    for t in range(tables):
        first, second, gap = (np.empty((n, width), kind) for kind in (np.int64, np.int64, float))
        for j in range(width):
            y = x
            for s in signs[t, j]:
                y = hadamard(y * s) / np.sqrt(d)
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            val = np.take_along_axis(size, top, 1)
            swap = (val[:, 0] < val[:, 1]) | ((val[:, 0] == val[:, 1]) & (top[:, 0] > top[:, 1]))
            top[swap] = top[swap][:, ::-1]
            code = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            first[:, j], second[:, j], gap[:, j] = code[:, 0], code[:, 1], np.abs(val[:, 0] - val[:, 1])
        scale = (2 * d) ** np.arange(width)
        out[:, t, 0] = first @ scale
        unsure = np.argsort(gap, 1, kind="stable")
        for p in range(out.shape[2] - 1):
            j = unsure[:, p]
            out[:, t, 1 + p] = out[:, t, 0] + (second[rows, j] - first[rows, j]) * scale[j]
    return out


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Every row's id, with label, dim, vector and a 128-bit key of its class; all null but the id if it can't link."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.size(v) > 0
    fine &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine &= F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
    fine = F.coalesce(fine, F.lit(False))
    out = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.col(label_col)).alias("label"), F.when(fine, v).alias("v"))
    return out.withColumns({"dim": F.size("v"), "h1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "label", "v"))})


def _hashed(classes: DataFrame, width: int, tables: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            flat = cols["v"].flatten().to_numpy()
            dims = cols["dim"].to_numpy()
            starts = np.concatenate(([0], np.cumsum(dims)[:-1])).astype(np.int64)
            codes: list = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                v = flat[starts[at][:, None] + np.arange(d)]
                v = v / np.abs(v).max(1, keepdims=True)
                found = buckets(v / np.linalg.norm(v, axis=1, keepdims=True), width, tables, probes)
                for i, row in zip(at.tolist(), found.reshape(len(at), -1).tolist(), strict=True):
                    codes[i] = row
            cols["codes"] = pa.array(codes, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(cols)

    kinds = dict(classes.dtypes)
    return classes.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in classes.columns) + ", codes array<long>")


def _compare(ids, weight, v, codes, chunk, ends, bucket, n_tables, cosine):
    """Of one block: ids with a link, links first met here, least id linked to them here."""
    v = v / np.abs(v).max(1, keepdims=True)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(v @ v.T >= cosine, 1))
    if ends[0] != ends[1]:
        across = chunk[i] != chunk[j]
        i, j = i[across], j[across]
    if not len(i):
        return ids[:0], weight[:0], ids[:0]
    table, code = bucket >> 48, bucket & ((1 << 48) - 1)
    codes = codes.reshape(len(ids), n_tables, -1)
    here = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = codes[i[at : at + (1 << 16)]], codes[j[at : at + (1 << 16)]]
        met = a[:, :, :, None] == b[:, :, None, :]
        first = met.any((2, 3)).argmax(1)
        k = np.arange(len(a))
        least = np.where(met[k, first].any(2), a[k, first], np.iinfo(np.int64).max).min(1)
        here[at : at + (1 << 16)] = (first == table) & (least == code)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i[here], weight[j[here]])
    np.add.at(links, j[here], weight[i[here]])
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    keep = np.zeros(len(ids), bool)
    keep[i] = keep[j] = True
    return ids[keep], links[keep], ids[order[root]][keep]


def near_links(classes: DataFrame, work: Workspace, *, cosine: float, width: int = WIDTH, tables: int = TABLES, probes: int = PROBES, chunk: int = CHUNK) -> DataFrame:
    """(id, links, root) per class and block where it links; ``classes``: id, label, dim, n, v."""
    hashed = work.save(_hashed(classes, width, tables, probes), "hashed")
    per = 1 + min(probes, width)
    code = F.transform("codes", lambda c, k: F.shiftleft(F.floor(k / per).cast("long"), 48) + c)
    slim = hashed.select("id", "label", "dim", F.explode(F.array_distinct(code)).alias("bucket"))
    sizes = slim.groupBy(*KEY).agg(F.count("*").alias("m")).filter("m > 1")
    members = slim.join(sizes, KEY).withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    members = members.withColumn("other", other).withColumns({"c1": F.least("chunk", "other"), "c2": F.greatest("chunk", "other")})
    rows = members.join(hashed.select("id", "n", "v", "codes"), "id").select("bucket", "c1", "c2", "label", "dim", "chunk", "id", "n", "v", "codes")
    block = ["label", "dim", "bucket", "c1", "c2"]
    dealt = rows.repartition(*block).sortWithinPartitions(*block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, n, ch = (t.column(c).to_numpy() for c in ("id", "n", "chunk"))
            v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            codes = t.column("codes").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            first = t.slice(0, 1).to_pylist()[0]
            out = _compare(ids, n, v, codes, ch, (first["c1"], first["c2"]), first["bucket"], tables, cosine)
            return pa.RecordBatch.from_pydict(dict(zip(("id", "links", "root"), map(pa.array, out), strict=True)))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in block), strict=True))
            at = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[at]:
                    if held and keys[at] != last:
                        yield flush()
                        held.clear()
                    held.append(batch.slice(at, k - at))
                    last, at = keys[at], k
        if held:
            yield flush()

    return dealt.mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, *, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """Per row: id_col, n_links, component_id, kept."""
    need(vectors, id_col, vec_col, label_col)
    work = Workspace(vectors.sparkSession, "near_vectors")
    rows = _classes(vectors, id_col, vec_col, label_col)
    classes = rows.filter("v is not null and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = work.save(classes, "classes")
    found = work.save(near_links(classes.select("id", "label", "dim", "n", "v"), work, cosine=cosine, **options), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), work)
    known = classes.select("h1", "h2", "id", "n").join(links, "id", "left").join(groups, "id", "left")
    known = known.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("h1")).alias("h1"), "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
