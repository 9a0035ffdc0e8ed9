"""Interval work on one axis: islands, overlap groups, padding, as-of lookups, top-k."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoweave.operators.grouped import map_groups

ROWS_A_TASK = 500_000


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _until(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def distinct_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The distinct rows of ``df`` (whose columns are the keys and those of ``order``), dealt out by the keys and sorted.

    Rows that are equal follow on one another, so none are held.  The number of tasks
    grows with the rows, so a task's memory doesn't; windows over the keys in this
    order need no other shuffle or sort.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_A_TASK))
    row = F.struct(*order)
    before = F.lag(row).over(Window.partitionBy(*keys).orderBy(*order))
    return df.repartition(tasks, *keys).withColumn("__b", before).filter(~F.col("__b").eqNullSafe(row)).drop("__b")


def islands(df: DataFrame, keys: list[str], pos: str, step: int = 4, out: str = "island") -> DataFrame:
    """Numbers runs of positions; a step of ``step`` or more starts a new one."""
    w = Window.partitionBy(*keys).orderBy(pos)
    new = F.when(F.abs(F.col(pos) - F.lag(pos).over(w)) >= step, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(_until(w))).drop("__new")


def overlap_groups(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 0, out: str = "grp") -> DataFrame:
    """Numbers groups of intervals that touch, directly or through others, within ``slack``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(_before(w))
    return df.withColumn("__new", F.when(F.col(start) > reach + slack, 1).otherwise(0)).withColumn(out, F.sum("__new").over(_until(w))).drop("__new")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """The union of intervals: keys, start, end and n, the number merged."""
    grouped = overlap_groups(df, keys, start, end, slack, "__grp")
    return grouped.groupBy(*keys, "__grp").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__grp")


def pad_and_merge(df: DataFrame, keys: list[str], start: str, end: str, pad: int, outer: int, low: Column, high: Column) -> DataFrame:
    """Pads intervals by ``pad``, the outermost ends of each key by ``outer``, clamps, and merges."""
    w = Window.partitionBy(*keys)
    first, last = F.min(start).over(w), F.max(end).over(w)
    a = F.greatest(F.when(F.col(start) == first, F.col(start) - outer).otherwise(F.col(start) - pad), low)
    b = F.least(F.when(F.col(end) == last, F.col(end) + outer).otherwise(F.col(end) + pad), high)
    return merge_intervals(df.withColumns({"__a": a, "__b": b}).select(*keys, F.col("__a").alias(start), F.col("__b").alias(end)), keys, start, end)


def _sides(ranges: list[tuple[int, int]], span: int, by_centre: bool) -> list[str]:
    """The path of each range as clusters that span ``span`` or more are cut at their middle."""
    out = [""] * len(ranges)
    todo = [list(range(len(ranges)))]
    while todo:
        own = todo.pop()
        lo, hi, last = min(ranges[k][0] for k in own), max(ranges[k][1] for k in own), max(ranges[k][0] for k in own)
        if hi - lo < span or (last == lo and not by_centre):
            continue
        middle = min((lo + hi) // 2, last)
        left = [k for k in own if (sum(ranges[k]) < lo + hi if by_centre else ranges[k][0] < middle)]
        gone = set(left)
        right = [k for k in own if k not in gone]
        if not left or not right:
            continue
        for side, part in (("0", left), ("1", right)):
            for k in part:
                out[k] += side
            todo.append(part)
    return out


def bisect(df: DataFrame, keys: list[str], start: str, end: str, span: int, out: str = "cluster", by_centre: bool = False) -> DataFrame:
    """Clusters ranges: a cluster spanning ``span`` or more is cut at its middle, until none is.

    A range goes to the side of its start, or of its centre.  ``out`` is the path of
    sides taken.  A cluster that a cut would leave whole stays.  A task holds one
    key's ranges at a time and cuts them to the end in one pass.
    """
    at = [df.columns.index(c) for c in (start, end)]

    def run(rows: list[tuple]) -> Iterator[tuple]:
        for row, path in zip(rows, _sides([(r[at[0]], r[at[1]]) for r in rows], span, by_centre), strict=True):
            yield *row, path

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return map_groups(df, keys, [start, end], run, f"{schema}, `{out}` string")


def cluster_ranges(df: DataFrame, keys: list[str], start: str, end: str, span: int) -> DataFrame:
    """keys, start and end of the clusters that ``bisect`` makes by the ranges' centres."""
    return bisect(df.select(*keys, start, end), keys, start, end, span, "__path", by_centre=True).groupBy(*keys, "__path").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__path")


def running_offsets(df: DataFrame, keys: list[str], order: list[str], length: str, out: str = "offset") -> DataFrame:
    """The place where each range begins (from 1) when a key's ranges stand one after the other."""
    w = _before(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, 1 + F.coalesce(F.sum(length).over(w), F.lit(0)))


def as_of(points: DataFrame, marks: DataFrame, keys: list[str], pos: str, carry: list[str]) -> DataFrame:
    """Each point with the ``carry`` columns of the last mark at or before it (null if none).

    One sort of both sides together per key, instead of a join on a range.
    """
    none = {c: F.lit(None).cast(t) for c, t in points.dtypes if c not in keys and c != pos}
    blank = {c: F.lit(None).cast(t) for c, t in marks.dtypes if c in carry}
    both = points.withColumns({**blank, "__kind": F.lit(1)}).unionByName(marks.select(*keys, pos, *carry).withColumns({**none, "__kind": F.lit(0)}))
    w = _until(Window.partitionBy(*keys).orderBy(pos, "__kind"))
    mark = F.last(F.when(F.col("__kind") == 0, F.struct(*carry)), True).over(w)
    out = both.withColumn("__mark", mark).filter("__kind = 1")
    return out.select(*points.columns, *[F.col(f"__mark.{c}").alias(c) for c in carry])


def band_pairs(df: DataFrame, keys: list[str], start: str, end: str, overlap: int = 4, tag: str = "id") -> DataFrame:
    """Ordered pairs of a key's intervals: y starts and ends later than x, and not over ``overlap`` away.

    Pairs meet in bins as wide as the longest interval, so a key's intervals
    are compared with near ones only.
    """
    width = F.greatest(F.max(F.col(end) - F.col(start)) + overlap + 2, F.lit(1))
    bins = df.groupBy(*keys).agg(width.alias("__w"))
    x = df.join(bins, keys).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("__w")), F.floor(F.col(start) / F.col("__w")) + 1)))
    y = df.join(bins, keys).withColumn("__bin", F.floor(F.col(start) / F.col("__w")))
    x = x.select(*keys, "__bin", F.col(tag).alias("x"), F.col(start).alias("xa"), F.col(end).alias("xb"))
    y = y.select(*keys, "__bin", F.col(tag).alias("y"), F.col(start).alias("ya"), F.col(end).alias("yb"))
    return x.join(y, [*keys, "__bin"]).filter((F.col("xa") < F.col("ya")) & (F.col("xb") < F.col("yb")) & (F.col("xb") - F.col("ya") + 1 >= -overlap)).drop("__bin")


def top_with_ties(df: DataFrame, keys: list[str], value: Column, k: int) -> DataFrame:
    """The rows whose value is among the ``k`` greatest of their key, ties included."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(value.desc()))
    return df.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter(F.col("__n") <= k).drop("__n")


def cap_if_over(df: DataFrame, keys: list[str], group: list[str], order: list[str], limit: int, keep: int) -> DataFrame:
    """For keys with over ``limit`` rows, the first ``keep`` rows of each ``group``; other keys whole."""
    total = F.count("*").over(Window.partitionBy(*keys))
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumns({"__t": total, "__n": n}).filter((F.col("__t") <= limit) | (F.col("__n") <= keep)).drop("__t", "__n")


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Of runs of equal values only the first row."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__b", before).filter(~F.col("__b").eqNullSafe(F.col(value)) | F.col("__b").isNull()).drop("__b")


def coalesce_ranges(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Joins ranges that follow on one another without a gap: [a..b][b+1..c] is [a..c]."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    new = F.when(F.col(start) == F.lag(end).over(w) + 1, 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(_until(w)))
    return marked.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def out_of_order(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, strand: str, out: str = "rearranged") -> DataFrame:
    """Whether an interval begins before the one before it on its key ended, in the direction of the strand."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))
    bad = F.when(F.col(strand) < 0, F.col(start) > before).otherwise(F.col(start) < before)
    return df.withColumn(out, F.coalesce(bad, F.lit(False)))
