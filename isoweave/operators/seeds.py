"""Seeds between sequences, their diagonals, and ungapped extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from isoweave.operators.grouped import dealt


def kmers(df: DataFrame, keys: list[str], seq: str, k: int, step: int = 1, out: str = "pos") -> DataFrame:
    """(keys, out, kmer) at every ``step``-th place, from 0; sequences shorter than ``k`` have none."""
    n = F.length(seq) - k
    places = F.explode(F.sequence(F.lit(0), n, F.lit(step)))
    return df.filter(n >= 0).withColumn(out, places).select(*keys, out, F.substr(F.col(seq), F.col(out) + 1, F.lit(k)).alias("kmer"))


def seed_diagonals(query: DataFrame, target: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """Per query, target and diagonal: the number of shared blocks and the first and last of them.

    ``query`` and ``target`` have keys, id and seq.  Blocks of the query don't
    overlap; a block that stands at place p of the query and p' of the target is
    on the diagonal p' - p.  An equi-join on the block replaces a scan of all pairs.
    """
    q = kmers(query.withColumnRenamed("id", "q"), [*keys, "q"], "seq", k, k, "qp")
    t = kmers(target.withColumnRenamed("id", "t"), [*keys, "t"], "seq", k, 1, "tp")
    hits = q.join(t, [*keys, "kmer"]).filter("q <> t").withColumn("diag", F.col("tp") - F.col("qp"))
    return hits.groupBy(*keys, "q", "t", "diag").agg(F.count("*").alias("n"), F.min("qp").alias("s0"), (F.max("qp") + k - 1).alias("e0"))


def mismatches(q: Column, t: Column, diag: Column) -> Column:
    """The places of the query, where both sequences reach, at which they differ on a diagonal."""
    a, b = (F.filter(F.split(x, ""), lambda c: c != "") for x in (q, t))
    lo, hi = F.greatest(F.lit(0), -diag), F.least(F.size(a) - 1, F.size(b) - 1 - diag)
    return F.filter(F.sequence(lo, hi), lambda i: F.get(a, i) != F.get(b, i + diag))


def extend(diagonals: DataFrame, query: DataFrame, target: DataFrame, keys: list[str], allow: int = 2) -> DataFrame:
    """Adds start and end: the seeds' stretch grown both ways, up to the mismatch after ``allow`` more.

    The diagonals of two sequences travel together, with one copy of each sequence;
    a diagonal of the two is compared once, as one array against a shift of the other.
    """
    kinds = dict(diagonals.dtypes)
    own = [c for c in diagonals.columns if c not in (*keys, "q", "t")]
    pairs = diagonals.groupBy(*keys, "q", "t").agg(F.collect_list(F.struct(*own)).alias("own"))
    both = pairs.join(query.withColumnsRenamed({"id": "q", "seq": "qs"}), [*keys, "q"]).join(target.withColumnsRenamed({"id": "t", "seq": "ts"}), [*keys, "t"])
    head = [*keys, "q", "t"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*head, *own)) + ", start int, end int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for *names, found, q, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (q, t))
                for d in found:
                    lo, hi = max(0, -d["diag"]), min(len(a) - 1, len(b) - 1 - d["diag"])
                    unlike = lo + np.flatnonzero(a[lo : hi + 1] != b[lo + d["diag"] : hi + 1 + d["diag"]])
                    left, right = unlike[: np.searchsorted(unlike, d["s0"])], unlike[np.searchsorted(unlike, d["e0"], "right") :]
                    out.append((*names, *d.values(), int(left[-allow - 1]) + 1 if len(left) > allow else lo, int(right[allow]) - 1 if len(right) > allow else hi))
            columns = zip(*out, strict=True) if out else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    dealt_out = dealt(both.select(*head, "own", "qs", "ts"), ["q", "t"])
    return dealt_out.mapInArrow(run, schema)
