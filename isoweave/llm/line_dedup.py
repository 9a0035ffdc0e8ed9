"""Line deduplication over levelled, sorted runs of line hashes.

Documents are taken in batches of ascending id.  The keys of a batch are
merge-anti-joined with the runs of all earlier batches; keys that no run holds
become a new sorted run at level 0, with the smallest document that holds them.
``fanout`` runs of one level are merged into one run of the next, so that a
batch meets O(fanout * log(batches)) runs.  Runs are bucketed and sorted by
hash: joins read them in place, without a shuffle or a sort of their own.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case; keys under ``min_chars`` code points never count.  A key found in
two or more documents stays only in the smallest id that holds it (all its
lines there), and loses its lines everywhere else.

Defined cases: null or empty text is one empty line; a null id neither owns nor
loses lines; rows with the same id count as one document; extra columns pass
through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, arrow_map, need

SPACE = b" \t\n\x0b\x0c\r"
KEY = ["k1", "k2"]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """Per line the 128-bit hash of its key, or None for a key too short to count."""
    keys = [line.strip(SPACE).lower() for line in text.split(b"\n")]
    return [xxhash.xxh3_128_digest(k) if _long_enough(k, min_chars) else None for k in keys]


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per document and distinct key: id, k1, k2 (the two halves of the hash)."""

    def keys(batch: pa.RecordBatch) -> dict:
        ids, digests = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {h for h in _line_hashes(text or b"", min_chars) if h}
            ids += [i] * len(own)
            digests += own
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return {"id": pa.array(ids, pa.int64()), "k1": pa.array(halves[:, 0]), "k2": pa.array(halves[:, 1])}

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return arrow_map(src.filter("id is not null"), keys, "id long, k1 long, k2 long")


class SortedRuns:
    """Runs of (k1, k2, owner), each a table bucketed and sorted by the key, kept by level."""

    def __init__(self, work: Workspace, fanout: int):
        self.spark, self.work, self.fanout = work.spark, work, fanout
        self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[str]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose key no run holds."""
        for run in self.tables():
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        out = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        out.option("path", self.work.path(name)).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        self.work.drop(name)

    def add(self, rows: DataFrame, level: int = 0) -> None:
        """Add a run; when a level is full, merge its runs into one of the next level."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.add(merged, level + 1)
            for name in full:
                self._drop(name)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self._drop(name)
        self.levels = []


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """One row per document that loses lines: id, keys (the hashes of the lines it loses)."""
    need(docs, id_col, text_col)
    work = Workspace(docs.sparkSession, "line_dedup")
    lines = line_keys(docs, id_col, text_col, min_chars)
    steps = [k / batches for k in range(1, batches)]
    cuts = sorted(set(docs.select(F.col(id_col).cast("double").alias("id")).approxQuantile("id", steps, 0.02))) if steps else []
    batch_no = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = work.save(lines.withColumn("batch", batch_no.cast("int")), "lines", ("batch",))
    runs = SortedRuns(work, fanout)
    for b in range(len(cuts) + 1):
        keys = lines.filter(F.col("batch") == b).groupBy(*KEY).agg(F.min("id").alias("owner"))
        runs.add(runs.unseen(keys))
    owned = runs.tables()
    owners = owned[0]
    for run in owned[1:]:
        owners = owners.unionByName(run)
    lost = lines.join(owners, KEY).filter("id <> owner")
    per_doc = lost.groupBy("id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))
    out = work.save(per_doc, "lost")
    runs.close()
    work.drop("lines")
    return out


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3, counts: bool = True) -> DataFrame:
    """``docs`` with the repeated lines gone from its text, in the same columns.

    ``counts`` adds n_lines (before) and n_dropped, in place of columns so named.
    """
    need(docs, id_col, text_col)
    lost = repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, batches=batches, fanout=fanout)
    keys = lost.select(F.col("id").alias("__id"), F.col("keys").alias("__keys"))
    joined = docs.join(keys, F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(text, lost_keys):
        import pandas as pd

        kept_texts, n_lines, n_dropped = [], [], []
        for t, gone in zip(text, lost_keys, strict=True):
            lines = (t or b"").split(b"\n")
            kept = lines
            if gone is not None and len(gone):
                gone = {np.array([g["k1"], g["k2"]], "<i8").tobytes() for g in gone}
                kept = [x for x, h in zip(lines, _line_hashes(t or b"", min_chars), strict=True) if h is None or h not in gone]
            kept_texts.append(b"\n".join(kept).decode("utf-8", "replace"))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return pd.DataFrame({"text": kept_texts, "n_lines": n_lines, "n_dropped": n_dropped})

    done = joined.withColumn("__cut", cut(F.col(text_col).cast("binary"), F.col("__keys")))
    cols = [F.col("__cut.text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_dropped"))]
    extra = [F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_dropped").alias("n_dropped")] if counts else []
    return done.select(*cols, *extra)
