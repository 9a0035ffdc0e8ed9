"""Helpers that the operators share: durable tables, names, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
#: Spark's setting that removes a query's shuffle files when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or else the one of ``setCheckpointDir``.

    Where neither is set, on a single machine (tests) a temporary folder is made
    once per application and removed when the process ends; on a cluster, whose
    machines don't see each other's folders, that is an error.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    app = context.applicationId
    if app not in _OWN_DIRS:
        if named := context.getCheckpointDir():
            return named.rstrip("/")
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="isoweave-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
        context.setCheckpointDir(_OWN_DIRS[app])
    return "file://" + _OWN_DIRS[app]


def arrow_rows(rows: int) -> dict[str, str]:
    """The setting that bounds the rows of an Arrow batch (Spark's default: 10,000)."""
    return {_BATCH: str(rows)}


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings are these within, and what they were before after."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Workspace:
    """Tables of one run, written to the shared folder so that no lineage stands behind them.

    ``rows`` bounds the rows of an Arrow batch while one is written (Spark's default: 10,000).
    """

    def __init__(self, spark: SparkSession, name: str, rows: int | None = None):
        self.spark = spark
        self.settings = {_CLEANUP: "true"} | (arrow_rows(rows) if rows else {})
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` as Parquet and read it back; what follows no longer depends on executors.

        The table is whole then, so the shuffle files of its making go at once.
        """
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with held(self.spark, self.settings):
            writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def need(df: DataFrame, *names: str) -> None:
    """Fail early, by name, if a column is missing or stands there twice."""
    for name in names:
        if df.columns.count(name) != 1:
            raise ValueError(f"needs exactly one column {name!r}; has {df.columns}")


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict] | dict], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from a batch to a dict of columns (or several)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            for cols in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_pydict(cols)

    return df.mapInArrow(run, schema)


def word_lists(text: bytes, table: bytes, piece: int) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``piece`` bytes; ``table`` maps bytes, and a blank is what parts words."""
    if len(text) <= piece:
        yield text.translate(table).split()
        return
    at = 0
    while at < len(text):
        cut = min(at + piece, len(text))
        while cut < len(text) and table[text[cut]] != 32:
            cut += 1
        yield text[at:cut].translate(table).split()
        at = cut
