"""Files by gene and species that appear whole or not at all, what goes into them, and their readers.

``write_files`` takes rows (name, body) through a Python data source.  A task writes
its files under names of its own attempt into a staging folder beside the target;
the driver moves those of the attempts that count to their places when all tasks
are done, and removes the staging folder, also after a failure.  So a task that
runs twice leaves one file, and a job that fails leaves none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from isoweave.functions.bio import wrap

FORMAT = "isoweave_files"


def _store(path: str):
    """(file system, path): any store that pyarrow knows, or the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # staged path, name


class WholeFiles(DataSource):
    """Rows of (name, body): ``name`` is a path below the target folder, ``body`` all that the file holds."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema: StructType, overwrite: bool) -> WholeFileWriter:
        return WholeFileWriter(self.options["path"], self.options["run"], overwrite)


class WholeFileWriter(DataSourceWriter):
    def __init__(self, folder: str, run: str, overwrite: bool):
        self.folder, self.staging, self.overwrite = folder.rstrip("/"), f"{folder.rstrip('/')}/_staging-{run}", overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        store, where = _store(self.staging)
        attempt, files = f"{where}/{uuid.uuid4().hex}", []
        for row in iterator:
            if not files:
                store.create_dir(attempt, recursive=True)
            staged = f"{attempt}/{len(files)}"
            with store.open_output_stream(staged) as out:
                out.write((row.body or "").encode())
            files.append((staged, row.name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, where = _store(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"several bodies for one file: {sorted({n for n in names if names.count(n) > 1})[:5]}")
            for folder in {f"{where}/{n}".rsplit("/", 1)[0] for n in names}:
                store.create_dir(folder, recursive=True)
            for staged, name in files:
                store.move(staged, f"{where}/{name}")
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, where = _store(self.staging)
        if store.get_file_info(where).type != fs.FileType.NotFound:
            store.delete_dir(where)


def write_files(files: DataFrame, folder: str) -> None:
    """Write each row's ``body`` as the file ``name`` below ``folder``; a file of that name is replaced."""
    files.sparkSession.dataSource.register(WholeFiles)
    files.select("name", "body").write.format(FORMAT).mode("append").option("path", folder).option("run", uuid.uuid4().hex).save()


def _joined(lines: DataFrame, name: Column, order: list[str], line: str = "line") -> DataFrame:
    """One row (name, body) a file, its lines in order, each with a line end."""
    own = F.array_sort(F.collect_list(F.struct(*order, line)))
    body = F.concat(F.array_join(F.transform(own, lambda x: x[line]), "\n"), F.lit("\n"))
    return lines.withColumn("name", name).groupBy("name").agg(body.alias("body"))


def file_name(*parts: Column | str) -> Column:
    """A path of parts; what would nest deeper becomes ``_``, and a first ``.`` or ``_``, which hides files, ``-``."""
    safe = lambda p: F.regexp_replace(F.regexp_replace(p, "[/\\\\\\x00]", "_"), r"^[._]", "-")
    return F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else safe(p) for p in parts])


def family_files(proteins: DataFrame) -> DataFrame:
    """species/seqs/gene.fa: a family's sequences under their numbers, 240 letters a line."""
    line = F.concat(F.lit(">"), F.col("seq_id").cast("string"), F.lit("\n"), wrap(F.col("residues"), 240))
    return _joined(proteins.withColumn("line", line), file_name(F.col("species"), "seqs", F.concat("gene", F.lit(".fa"))), ["seq_id"])


def restore_case(rows: DataFrame, aligned: str = "aligned", residues: str = "residues") -> DataFrame:
    """``aligned`` with its letters as they are in ``residues``."""

    @F.pandas_udf("string")
    def restored(a: pd.Series, r: pd.Series) -> pd.Series:
        def one(row: str, own: str) -> str:
            letters = iter(own)
            return "".join(c if c in "-/" else next(letters, c) for c in row)

        return pd.Series([one(x or "", y or "") for x, y in zip(a, r, strict=True)], dtype=object)

    return rows.withColumn(aligned, restored(aligned, residues))


def named_rows(rows: DataFrame, names: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Adds ``title``: the sequence's own name, with its alternative frames (seq_id, label) as a comment.

    A name without a comment gets one after `` #``; one that has it goes on after a blank.
    """
    out = rows.join(names.select("seq_id", "orig_name"), "seq_id")
    if labels is None:
        return out.withColumn("title", F.col("orig_name")).drop("orig_name")
    out = out.join(labels.select("seq_id", F.col("label").alias("__label")), "seq_id", "left")
    sep = F.when(F.col("orig_name").contains("#"), " ").otherwise(" #")
    return out.withColumn("title", F.when(F.col("__label").isNull(), F.col("orig_name")).otherwise(F.concat("orig_name", sep, "__label"))).drop("__label", "orig_name")


def alignment_files(rows: DataFrame, name: Column, width: int = 60) -> DataFrame:
    """Aligned FASTA of rows (title, row_no, aligned), ``width`` columns a line."""
    line = F.concat(F.lit(">"), F.col("title"), F.lit("\n"), wrap(F.col("aligned"), width))
    return _joined(rows.withColumn("line", line), name, ["row_no"])


def mapping_text(maps: DataFrame) -> DataFrame:
    """Adds ``line``: a map (title, method, chr, note, exons) as text; residues are counted from 1."""
    exon = lambda e: F.concat(
        F.lit("* Aminos "), (e["a_start"] + 1).cast("string"), F.lit(".."), (e["a_end"] + 1).cast("string"), F.lit(", "), e["chr"], F.when(e["strand"] < 0, "[revcomp]").otherwise(""), F.lit(":"),
        e["n_start"].cast("string"), F.lit(".."), e["n_end"].cast("string"), F.lit("\n"), F.array_join(e["centres"].cast("array<string>"), ","),
    )
    note = F.when(F.col("note").isNull(), "").otherwise(F.concat(F.lit(" # "), F.regexp_replace("note", "; ", " # ")))
    head = F.concat(F.lit("Sequence ID: "), F.col("title"), F.lit("\nMap Method : "), F.col("method"), F.lit("\nChromosome : "), F.col("chr"), note, F.lit("\nNum Exons  : "), F.size("exons").cast("string"), F.lit("\n"))
    return maps.withColumn("line", F.concat(head, F.array_join(F.transform("exons", exon), "\n"), F.lit("\n")))


def mapping_files(maps: DataFrame, name: Column, head: Column | None = None) -> DataFrame:
    """A file of maps a name, under its canonical chromosome if ``head`` gives that."""
    lines = mapping_text(maps).withColumn("__part", F.lit(1))
    if head is not None:
        first = maps.withColumn("name", name).select("name", head.alias("__h")).distinct().groupBy("name").agg(F.min("__h").alias("__h"))
        body = _joined(lines, name, ["__part", "seq_id"]).join(first, "name")
        return body.select("name", F.concat(F.lit("Canonical Chromosome: "), "__h", F.lit("\n\n"), "body").alias("body"))
    return _joined(lines, name, ["__part", "seq_id"])


def miss_files(misses: DataFrame, name: Column) -> DataFrame:
    """``gene: reason: title`` a line, by gene and sequence."""
    line = F.concat_ws(": ", "gene", "reason", "title")
    return _joined(misses.withColumn("line", line), name, ["gene", "seq_id"])


def frame_files(labels: DataFrame, name: Column) -> DataFrame:
    """Of each sequence (title, label) with alternative frames, which residues are read so."""
    ranges = F.regexp_replace("label", "^ARFs?:", "")
    what = F.when(F.col("label").contains(","), "alternative reading frames").otherwise("an alternative reading frame")
    line = F.concat("title", F.lit("\n- Amino acids "), ranges, F.lit(" identified as "), what, F.lit("\n"))
    return _joined(labels.withColumn("line", line), name, ["seq_id"])


def prepared_files(entries: DataFrame, folder: str) -> dict[str, int]:
    """A prepared database as three folders of text, each written by all tasks: entries, changed names, what couldn't be parsed.

    ``entries``: header, dialect, species, gene, unique_id, residues, as the header
    parser gives them.  Returns the number of records in each; folders of none stay out.
    """
    fine = F.col("dialect") != "reject"
    title = F.concat_ws("|", "species", "gene", "unique_id")
    parts = {
        "prepared.fa": entries.filter(fine).select(F.concat(F.lit(">"), title, F.lit("\n"), wrap(F.col("residues"), 60)).alias("value")),
        "name-changes.out": entries.filter(fine & (F.trim("header") != title)).select(F.concat(F.col("header"), F.lit(" --> "), title).alias("value")),
        "unparseable.out": entries.filter(~fine).select(F.concat(F.lit(">"), "header", F.lit("\n"), wrap(F.col("residues"), 60)).alias("value")),
    }
    counts = {name: df.count() for name, df in parts.items()}
    for name, df in parts.items():
        if counts[name]:
            df.write.mode("error").text(f"{folder.rstrip('/')}/{name}")
    return counts


def numbered(rows: DataFrame, out: str = "seq_id") -> DataFrame:
    """The rows of files, numbered from 0 without gaps in the order of files and of rows in them.

    Tasks count the rows of each piece of a file that they read; the pieces' first
    numbers (one row a piece) go back to them, so no task sees more than its own rows.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    pieces = at.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    have = sorted(pieces.collect(), key=lambda r: (r[0], r[1]))
    firsts, before = [], 0
    for r in have:
        firsts.append((r[0], r[1], before - r.first))
        before += r.n
    shift = rows.sparkSession.createDataFrame(firsts, "__file string, __block long, __shift long")
    return at.join(F.broadcast(shift), ["__file", "__block"]).withColumn(out, F.col("__at") + F.col("__shift")).drop("__file", "__block", "__at", "__shift")


def read_alignments(spark: SparkSession, paths: str) -> DataFrame:
    """file, row_no, title, aligned: the rows of aligned FASTA files, between exon boundaries as the aligner takes them.

    A file whose first row has no boundary at its start, or at its end, gets one there in every row.
    """
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    records = text.select("file", F.posexplode(F.filter(F.split("value", r"(?m)^>"), lambda r: F.trim(r) != "")).alias("row_no", "r"))
    rows = records.select("file", "row_no", F.trim(F.regexp_extract("r", r"^([^\n\r]*)", 1)).alias("title"), F.regexp_replace(F.regexp_replace("r", r"^[^\n]*\n?", ""), r"\s", "").alias("aligned"))
    first = F.first("aligned").over(Window.partitionBy("file").orderBy("row_no"))
    rows = rows.withColumn("__first", first)
    left = F.when(F.substring("__first", 1, 1).isin("/", "-"), "").otherwise("/")
    right = F.when(F.col("__first").endswith("/"), "").otherwise("/")
    return rows.select("file", "row_no", "title", F.concat(left, "aligned", right).alias("aligned"))
