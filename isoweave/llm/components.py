"""Connected components of a distributed edge list, by alternating stars.

Each round hangs every node's larger neighbours on its smallest one (large
star), then a node and its smaller neighbours on the smallest (small star); the
edges end as stars around each component's least id.  All state is edges in
durable tables, so a round depends on no executor, and nothing is collected.
Where no more than ``SMALL`` edges are left, a task takes them all and joins them
at once (2 MB); the result is the same, but for the many small jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from isoweave.llm.common import Workspace

SMALL = 1 << 17


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """(id, component) of a few edges, by one task."""
    kind = dict(edges.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
        ids = list(root)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, edges_type), "component": pa.array([top(x) for x in ids], edges_type)})

    edges_type = to_arrow_schema(edges.select("a").schema).field(0).type
    return edges.select("a", "b").repartition(1).mapInArrow(run, f"id {kind}, component {kind}")


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(id, component) of every node that has an edge; component is the least id it reaches.

    ``edges`` has the columns a and b of one orderable type; loops and repeats
    are allowed, nulls are not.
    """
    now = work.save(_small_star(edges.filter("a <> b").select("a", "b")), f"{name}-0")
    state, k = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == state:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
        if mark.n <= SMALL:
            return _joined(now)
        state, k = mark, k + 1
        now = work.save(_small_star(_large_star(now)), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}")
