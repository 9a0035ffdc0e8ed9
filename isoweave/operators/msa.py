"""Alignments as cells: composition from genome coordinates, column profiles, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoweave.operators.intervals import islands


def cells(rows: DataFrame, keys: list[str], aligned: str) -> DataFrame:
    """keys, col (from 0), ch: a row per column of each aligned row."""
    chars = F.filter(F.split(aligned, ""), lambda c: c != "")
    return rows.select(*keys, F.posexplode(chars).alias("col", "ch"))


def rows_of(c: DataFrame, keys: list[str], out: str = "aligned") -> DataFrame:
    """The inverse of ``cells``."""
    own = F.array_sort(F.collect_list(F.struct("col", "ch")))
    return c.groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x["ch"]), "").alias(out))


def column_profile(c: DataFrame, group: list[str], ignore: Column | None = None, prefer: str | None = None) -> DataFrame:
    """Per column: n_distinct, top_ch, top_n; of equally common characters ``prefer``, if it is one of them, or the smallest is top.

    Cells for which ``ignore`` is true (a row's own, say) don't count.
    """
    c = c if ignore is None else c.filter(~ignore)
    n = c.groupBy(*group, "col", "ch").agg(F.count("*").alias("n"))
    top = F.min_by(F.struct("ch", "n"), F.struct((-F.col("n")).alias("k"), (F.col("ch") != F.lit(prefer or "")).alias("other"), "ch"))
    out = n.groupBy(*group, "col").agg(F.count("*").alias("n_distinct"), top.alias("top"))
    return out.select(*group, "col", "n_distinct", F.col("top.ch").alias("top_ch"), F.col("top.n").alias("top_n"))


def profile_ratios(c: DataFrame, group: list[str], gap: str = "-") -> DataFrame:
    """Per column and letter its share among the column's letters."""
    n = c.filter(F.col("ch") != gap).groupBy(*group, "col", "ch").agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(*group, "col"))).drop("n")


def drop_columns(c: DataFrame, group: list[str], gap: str = "-", boundary: str = "/") -> DataFrame:
    """Cells without boundary columns and all-gap columns, columns numbered anew."""
    kept = c.groupBy(*group, "col").agg(F.bool_or(F.col("ch") == boundary).alias("__b"), F.every(F.col("ch") == gap).alias("__g")).filter("not __b and not __g")
    renumbered = kept.select(*group, "col", (F.row_number().over(Window.partitionBy(*group).orderBy("col")) - 1).alias("new"))
    return c.join(renumbered, [*group, "col"]).drop("col").withColumnRenamed("new", "col")


def nearest_boundary(columns: DataFrame, group: list[str], is_boundary: str, out: str = "distance") -> DataFrame:
    """Distance of each column to the nearest boundary on either side; null if there is none."""
    w = Window.partitionBy(*group).orderBy("col")
    mark = F.when(F.col(is_boundary), F.col("col"))
    back = F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(mark, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return columns.withColumn(out, F.least(F.col("col") - back, ahead - F.col("col")))


def last_letter(c: DataFrame, row: list[str], gap: str = "-", out: str = "last_col") -> DataFrame:
    """For each cell the last column up to it that is no gap."""
    w = Window.partitionBy(*row).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn(out, F.last(F.when(F.col("ch") != gap, F.col("col")), True).over(w))


def running_residue(c: DataFrame, row: list[str], gap: str = "-", out: str = "residue") -> DataFrame:
    """For each cell the number of letters of its row up to it."""
    w = Window.partitionBy(*row).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn(out, F.sum(F.when(F.col("ch") != gap, 1).otherwise(0)).over(w))


def compose(mapped: DataFrame, group: list[str], seq: str, step: int = 4) -> DataFrame:
    """Alignment rows from mapped residues: group, seq, aligned.

    ``mapped`` has group, seq, pos (place on the genome, in reading direction)
    and ch.  Columns are the distinct places; a step of ``step`` or more starts a
    new exon, and exons stand between ``/`` columns.
    """
    places = islands(mapped.select(*group, "pos").distinct(), group, "pos", step)
    seqs = mapped.select(*group, seq).distinct()
    grid = seqs.join(places, group).join(mapped, [*group, seq, "pos"], "left").withColumn("ch", F.coalesce("ch", F.lit("-")))
    exon = grid.groupBy(*group, seq, "island").agg(F.array_sort(F.collect_list(F.struct("pos", "ch"))).alias("c"))
    exon = exon.withColumn("part", F.array_join(F.transform("c", lambda x: x["ch"]), ""))
    row = exon.groupBy(*group, seq).agg(F.array_sort(F.collect_list(F.struct("island", "part"))).alias("e"))
    return row.select(*group, seq, F.concat(F.lit("/"), F.array_join(F.transform("e", lambda x: x["part"]), "/"), F.lit("/")).alias("aligned"))
