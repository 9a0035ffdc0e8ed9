"""Translated search of proteins over a whole genome, and the plan of spliced searches that follows from its hits.

Tiles of ``TILE`` residues, end to end in all six reading frames of the genome,
meet the proteins' tiles at every place in an equi-join of numbers.  Places are
those of the whole chromosome, so that seeds of one diagonal chain across chunk
borders, and a tile at a border is read with the bases that follow.  Tiles that
stand too often in the genome (repeats) seed nothing, so no tile's list is long;
they still count in the extension.  Chains grow both ways by their best sum of
matches less mismatches, over the bases fetched around them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoweave.functions.bio import AMINO, percent_tenths
from isoweave.operators.durable import kept
from isoweave.operators.grouped import map_groups
from isoweave.operators.intervals import cap_if_over, cluster_ranges, merge_intervals, overlap_groups, top_with_ties
from isoweave.operators.mapping import covers
from isoweave.operators.spliced import _BASE, CODON, STOP, SpliceCosts, spliced_maps
from isoweave.sources.text import fetch

TILE, REPEATS, LEAST_SCORE, LEAST_PCT, DROP = 7, 1024, 40, 90.0, 8
_BITS = 5
#: Slots of the filter that keeps the genome's tiles which no protein has out of the shuffle.
SLOT_BITS = 22


def _tile_numbers(amino: np.ndarray) -> np.ndarray:
    """The number of the tile at each place of a row of residues; -1 where it holds a stop or an unknown one."""
    n = len(amino) - TILE + 1
    if n <= 0:
        return np.empty(0, np.int64)
    parts = np.lib.stride_tricks.sliding_window_view(amino, TILE)
    return np.where((parts < 20).all(1), parts @ (1 << _BITS * np.arange(TILE, dtype=np.int64)), -1)


def _slot(tile: np.ndarray) -> np.ndarray:
    return (tile.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def tile_filter(seqs: DataFrame) -> np.ndarray:
    """A bitmap of the slots that the proteins' tiles fall in; tiles of other slots meet none.

    Words are joined on the executors; the driver gets one row a word, 2 ** (SLOT_BITS - 5) at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slot(batch.column(0).to_numpy())).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(slot >> 5), "bits": pa.array(1 << (slot & 31))})

    words = protein_tiles(seqs).select("tile").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (SLOT_BITS - 5), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.astype(np.uint32)


def genome_tiles(chunks: DataFrame, size: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(tile, chr, strand, at): non-overlapping tiles of every frame; ``at`` is strand * the place of the first base read.

    With ``wanted`` (of ``tile_filter``) only tiles of its slots.
    """
    words = None if wanted is None else chunks.sparkSession.sparkContext.broadcast(wanted)
    after = chunks.select("chr", (F.col("chunk") - 1).alias("chunk"), F.substring("seq", 1, 3 * TILE - 1).alias("more"))
    whole = chunks.join(after, ["chr", "chunk"], "left").select("chr", "chunk", "seq", F.coalesce("more", F.lit("")).alias("more"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chrom, chunk, seq, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _BASE[np.frombuffer((seq + more).encode("latin-1", "replace"), np.uint8)]
                if len(x) < 3 * TILE:
                    continue
                first = chunk * size  # places of the chromosome, from 0, of this chunk's bases
                for strand in (1, -1):
                    flipped = np.where(x < 4, 3 - x, 4)
                    amino = CODON[x[:-2], x[1:-1], x[2:]] if strand > 0 else CODON[flipped[2:], flipped[1:-1], flipped[:-2]]
                    for frame in range(3):
                        # of each frame every TILE-th codon of the chromosome, if the tile begins in this chunk
                        start = (frame - first) % 3
                        codon0 = (first + start) // 3
                        start += 3 * (-codon0 % TILE)
                        own = amino[start::3]
                        n = len(own) // TILE
                        tiles = own[: n * TILE].reshape(n, TILE)[:, :: 1 if strand > 0 else -1]
                        number = np.where((tiles < 20).all(1), tiles @ (1 << _BITS * np.arange(TILE, dtype=np.int64)), -1)
                        at = start + 3 * TILE * np.arange(n)
                        fine = (number >= 0) & (at < len(seq))
                        if words is not None:
                            slot = _slot(number)
                            fine &= (words.value[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1
                        if not fine.any():
                            continue
                        place = first + at[fine] + 1 if strand > 0 else -(first + at[fine] + 3 * TILE)
                        k = int(fine.sum())
                        yield pa.RecordBatch.from_pydict({"tile": pa.array(number[fine]), "chr": pa.array([chrom] * k, pa.string()), "strand": pa.array(np.full(k, strand), pa.int32()), "at": pa.array(place.astype(np.int64))})

    return whole.mapInArrow(run, "tile long, chr string, strand int, at long")


def protein_tiles(seqs: DataFrame) -> DataFrame:
    """(tile, seq_id, a): every tile of every protein, at its first residue from 0."""
    kind = dict(seqs.dtypes)["seq_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, residues in enumerate(batch.column(1).to_pylist()):
                number = _tile_numbers(np.array([AMINO.find(c) if c in AMINO else STOP for c in (residues or "").upper()], np.int64))
                a = np.flatnonzero(number >= 0)
                yield pa.RecordBatch.from_pydict({"tile": pa.array(number[a]), "seq_id": pa.array([ids[k].as_py()] * len(a), ids.type), "a": pa.array(a.astype(np.int32))})

    return seqs.select("seq_id", "residues").mapInArrow(run, f"tile long, seq_id {kind}, a int")


def chains(seqs: DataFrame, chunks: DataFrame, size: int, repeats: int = REPEATS, reach: int = 40) -> DataFrame:
    """(seq_id, chr, strand, diagonal, a_start, a_end): seeds of one diagonal at most ``reach`` residues apart."""
    genome = kept(genome_tiles(chunks, size, tile_filter(seqs)).join(protein_tiles(seqs).select("tile").distinct(), "tile", "left_semi"))
    rare = genome.groupBy("tile").agg(F.count("*").alias("n")).filter(F.col("n") <= repeats).select("tile")
    seeds = genome.join(rare, "tile").join(protein_tiles(seqs), "tile").select("seq_id", "chr", "strand", (F.col("at") - 3 * F.col("a")).alias("diagonal"), F.col("a").alias("a_start"), (F.col("a") + TILE - 1).alias("a_end"))
    return merge_intervals(seeds, ["seq_id", "chr", "strand", "diagonal"], "a_start", "a_end", reach).drop("n")


def _grown(same: np.ndarray, fine: np.ndarray, a0: int, a1: int, drop: int) -> tuple[int, int]:
    """The stretch around a0..a1 with the best sum of matches less mismatches each way, up to a stop or a fall by ``drop``."""

    def way(gains: np.ndarray, ok: np.ndarray) -> int:
        if not len(gains):
            return 0
        n = len(ok) if ok.all() else int(ok.argmin())
        total = np.cumsum(gains[:n])
        best = np.maximum.accumulate(np.maximum(total, 0))
        low = np.flatnonzero(total <= best - drop)
        total = total[: low[0]] if len(low) else total
        return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0

    gain = np.where(same, 1, -1)
    return a0 - way(gain[:a0][::-1], fine[:a0][::-1]), a1 + way(gain[a1 + 1 :], fine[a1 + 1 :])


def translated_search(seqs: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = 1 << 16, *, repeats: int = REPEATS, least_score: int = LEAST_SCORE, least_pct: float = LEAST_PCT, drop: int = DROP) -> DataFrame:
    """Ungapped hits of ``seqs`` (seq_id, residues): seq_id, chr, strand, pct, a_start, a_end (from 0), n_start, n_end, score, each once.

    The score is three times the matches less the mismatches.  ``chunks`` and
    ``sizes`` are those of the genome, in chunks of ``size`` bases; reverse hits
    have n_start > n_end.
    """
    found = kept(chains(seqs, chunks, size, repeats))
    kind = dict(seqs.dtypes)["seq_id"]
    lengths = seqs.select("seq_id", F.upper("residues").alias("residues"), F.length("residues").alias("length"))
    span = found.join(lengths.select("seq_id", "length"), "seq_id").join(sizes.select("chr", "size"), "chr")
    # the codons of the whole protein on this diagonal, as far as the chromosome reaches
    one = F.when(F.col("strand") > 0, F.lit(1)).otherwise(-F.col("size"))
    last = F.when(F.col("strand") > 0, F.col("size")).otherwise(F.lit(-1))
    r0 = F.greatest(F.lit(0).cast("long"), F.ceil((one - F.col("diagonal")) / 3))
    r1 = F.least(F.col("length") - 1, F.floor((last - F.col("diagonal") - 2) / 3))
    key = ["seq_id", "chr", "strand", "diagonal"]
    span = span.groupBy(*key).agg(F.first(r0).alias("r0"), F.first(r1).alias("r1"), F.array_sort(F.collect_list(F.struct("a_start", "a_end"))).alias("own"))
    span = span.withColumns({"a": F.abs(F.col("diagonal") + 3 * F.col("r0")), "b": F.abs(F.col("diagonal") + 3 * F.col("r1") + 2)})
    bases = fetch(chunks, span.select(*key, "a", "b"), size, ["seq_id", "strand", "diagonal"])
    rows = bases.select(*key, "nucls").join(span.select(*key, "r0", "own"), key).join(lengths.select("seq_id", "residues"), "seq_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for seq_id, chrom, strand, diagonal, nucls, first, own, residues in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _BASE[np.frombuffer(nucls.encode("latin-1", "replace"), np.uint8)]
                n = len(x) // 3
                amino = CODON[tuple(x[: 3 * n].reshape(n, 3).T)]
                want = np.array([AMINO.find(c) if c in AMINO else 30 for c in residues[first : first + n]])
                same, fine = amino == want, amino != STOP
                done = -1
                for chain in own:
                    if chain["a_start"] <= done:
                        continue  # the one before has grown over it
                    s, e = _grown(same, fine, chain["a_start"] - first, chain["a_end"] - first, drop)
                    done = e + first
                    hits = int(same[s : e + 1].sum())
                    row = (seq_id, chrom, strand, s + first, e + first, abs(diagonal + 3 * (s + first)), abs(diagonal + 3 * (e + first) + 2), hits, e - s + 1)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            names = ("seq_id", "chr", "strand", "a_start", "a_end", "n_start", "n_end", "hits", "len")
            kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=list(names))

    cols = rows.select(*key, "nucls", F.col("r0").cast("int"), "own", "residues")
    hits = cols.mapInArrow(run, f"seq_id {kind}, chr string, strand int, a_start int, a_end int, n_start long, n_end long, hits long, len long")
    hits = hits.withColumns({"score": 3 * (2 * F.col("hits") - F.col("len")), "pct": percent_tenths(F.col("hits"), F.col("len"))})
    return hits.filter((F.col("score") >= least_score) & (F.col("pct") >= least_pct)).select("seq_id", "chr", "strand", "pct", "a_start", "a_end", "n_start", "n_end", "score").distinct()


def best_before_stop(candidates: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each key's best candidate, as a search finds it that goes on while candidates improve.

    Candidates come in ``order``; a null or zero value is a failed one.  After the
    first success the search stops at the first candidate that is no better than the
    best so far, so a better one behind that is not seen.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    best = F.max(F.coalesce(value, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stops = F.when((best > 0) & (F.coalesce(F.col(value), F.lit(0)) <= best), 1).otherwise(0)
    seen = candidates.withColumn("__stop", stops).withColumn("__stop", F.sum("__stop").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    tried = seen.filter((F.col("__stop") == 0) & (F.coalesce(value, F.lit(0)) > 0)).drop("__stop")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    return tried.withColumn("__n", last).filter("__n = 1").drop("__n")


SPAN, INNER_PAD, OUTER_PAD, TOP, MOST_HITS, HITS_A_CHROMOSOME = 1_000_000, 10_000, 50_000, 5, 5000, 100


def hit_groups(hits: DataFrame) -> DataFrame:
    """Hits with grp (those of a chromosome strand that touch on the protein within 25 residues), and g_start and g_end of the group."""
    on = ["seq_id", "chr", "strand"]
    grouped = overlap_groups(hits, on, "a_start", "a_end", slack=25)
    w = Window.partitionBy(*on, "grp")
    return grouped.withColumns({"g_start": F.min("a_start").over(w), "g_end": F.max("a_end").over(w)})


def coverage(groups: DataFrame) -> DataFrame:
    """seq_id, chr, strand, covered: the residues that a chromosome strand's groups span."""
    each = groups.select("seq_id", "chr", "strand", "grp", "g_start", "g_end").distinct()
    return each.groupBy("seq_id", "chr", "strand").agg(F.sum(F.col("g_end") - F.col("g_start") + 1).alias("covered"))


def _padded(ranges: DataFrame, key: list[str], sizes: DataFrame) -> DataFrame:
    """Ranges (key, chr, strand, lo, hi) widened on both sides, the outermost ones more, clamped and merged: key, chr, strand, lo, hi."""
    w = Window.partitionBy(*key)
    first, last = F.min("lo").over(w) == F.col("lo"), F.max("hi").over(w) == F.col("hi")
    wide = ranges.join(sizes.select("chr", "size"), "chr").withColumns({
        "__a": F.greatest(F.col("lo") - INNER_PAD - F.when(first, OUTER_PAD).otherwise(0), F.lit(1)),
        "__b": F.least(F.col("hi") + INNER_PAD + F.when(last, OUTER_PAD).otherwise(0), F.col("size")),
    })
    return merge_intervals(wide.select(*key, F.col("__a").alias("lo"), F.col("__b").alias("hi")), key, "lo", "hi").drop("n")


def _in_order(ranges: DataFrame, key: list[str], first: list) -> DataFrame:
    """Searches of the ranges, as spliced alignment takes them: parts in reading order, reverse ones from their greater end."""
    strand = F.col("strand")
    part = F.row_number().over(Window.partitionBy(*key).orderBy(*first, F.when(strand > 0, F.col("lo")).otherwise(-F.col("hi"))))
    a, b = F.when(strand > 0, F.col("lo")).otherwise(F.col("hi")), F.when(strand > 0, F.col("hi")).otherwise(F.col("lo"))
    return ranges.withColumns({"part": part, "a": a, "b": b, "total": F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy(*key))})


def planned_ranges(hits: DataFrame, seqs: DataFrame, sizes: DataFrame, stage: int, most_bases: int) -> DataFrame:
    """The searches of one stage: seq_id, search (1 for the first tried), part, chr, strand, a, b.

    Stages 1 and 2 search the chromosome strands that cover most of the protein,
    five and all ties, if they cover three quarters of it: stage 1 over the hits of
    all groups together, stage 2 group by group.  Stage 3 joins the groups of all
    chromosomes, in their order on the protein.  Hits cluster into ranges under a
    megabase; searches over ``most_bases`` are left out.
    """
    capped = cap_if_over(hits.withColumn("hit_no", F.struct(-F.col("score"), "chr", "strand", "n_start", "a_start")), ["seq_id"], ["seq_id", "chr", "strand"], ["hit_no"], MOST_HITS, HITS_A_CHROMOSOME).drop("hit_no")
    groups = hit_groups(capped)
    ends = groups.withColumns({"lo": F.least("n_start", "n_end"), "hi": F.greatest("n_start", "n_end")})
    on = ["seq_id", "chr", "strand"]
    clusters = cluster_ranges(ends.select(*on, "grp", "g_start", "lo", "hi"), [*on, "grp", "g_start"], "lo", "hi", SPAN)
    if stage < 3:
        ranges = cluster_ranges(clusters, on, "lo", "hi", SPAN) if stage == 1 else clusters
        lengths = seqs.select("seq_id", F.length("residues").alias("length"))
        top = top_with_ties(coverage(groups), ["seq_id"], F.col("covered"), TOP).join(lengths, "seq_id").filter(covers(F.col("covered"), F.col("length")))
        nth = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("covered"), "chr", F.desc("strand"))).cast("long")
        ranked = top.select(*on, nth.alias("search"))
        padded = _padded(ranges, on, sizes).join(ranked, on)
        out = _in_order(padded, ["seq_id", "search"], [])
    else:
        padded = _padded(clusters, [*on, "grp", "g_start"], sizes).withColumn("search", F.lit(1).cast("long"))
        out = _in_order(padded, ["seq_id", "search"], ["g_start", "chr", F.desc("strand"), "grp"])
    return out.filter(F.col("total") <= most_bases).select("seq_id", "search", "part", "chr", "strand", "a", "b")


STAGES = ((1, 10_000_000, 90.0), (2, 10_000_000, 90.0), (3, 15_000_000, 75.0))


def staged_search(seqs: DataFrame, hits: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = 1 << 16, costs: SpliceCosts = SpliceCosts()) -> DataFrame:
    """The map of each sequence that one of three stages finds, each over what those before left: as ``spliced_maps``, with stage.

    Stages 1 and 2 take their searches in order and stop at the first that improves nothing.
    """
    done: DataFrame | None = None
    for stage, most, least_pct in STAGES:
        left = seqs if done is None else seqs.join(done.select("seq_id"), "seq_id", "left_anti")
        own = hits.join(left.select("seq_id"), "seq_id", "left_semi")
        searches = kept(planned_ranges(own, left, sizes, stage, most))
        if searches.isEmpty():
            continue
        found = spliced_maps(left, searches.drop("strand"), chunks, least_pct, size, costs)
        tried = searches.select("seq_id", "search").distinct().join(found, ["seq_id", "search"], "left")
        best = kept(best_before_stop(tried, ["seq_id"], ["search"], "pct_id").withColumn("stage", F.lit(stage)))
        done = best if done is None else done.unionByName(best)
    return done if done is not None else spliced_maps(seqs.limit(0), planned_ranges(hits.limit(0), seqs.limit(0), sizes, 1, 0).drop("strand"), chunks, 90.0, size, costs).withColumn("stage", F.lit(0))


def last_written(maps: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of several maps of a sequence the one written last."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return maps.withColumn("__n", newest).filter("__n = 1").drop("__n")
