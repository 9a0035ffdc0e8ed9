"""From proteins, annotations and genomes to alignments of isoform families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoweave.functions.bio import strand_label
from isoweave.operators.align import GapCosts, merge_by_steps, merge_families
from isoweave.operators.durable import kept
from isoweave.operators.frames import compose_frames
from isoweave.operators.mapping import canonical, exon_hits, with_misses
from isoweave.operators.search import best_before_stop, last_written, staged_search, translated_search
from isoweave.operators.spliced import spliced_maps
from isoweave.operators.weave import codon_centres, weave
from isoweave.sources.text import fetch

WINDOW = 36


def exon_windows(annotations: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = 1 << 16) -> DataFrame:
    """The bases of each annotated exon with ``WINDOW`` more on both sides, in reading direction."""
    a = annotations.join(sizes, "chr")
    lo, hi = F.least("start", "end"), F.greatest("start", "end")
    a = a.withColumns({"inner": hi - lo + 1, "w0": F.greatest(lo - WINDOW, F.lit(1)), "w1": F.least(hi + WINDOW, F.col("size"))})
    a = a.withColumns({"a": F.when(F.col("strand") > 0, F.col("w0")).otherwise(F.col("w1")), "b": F.when(F.col("strand") > 0, F.col("w1")).otherwise(F.col("w0"))})
    keys = ["gene", "strand", "exon_no", "inner"]
    a = a.withColumn("exon_no", F.col("line_no").cast("int"))
    return fetch(chunks, a.select(*keys, "chr", "a", "b"), size, keys).withColumnRenamed("a", "n_first")


def seed_maps(proteins: DataFrame, annotations: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = 1 << 16) -> DataFrame:
    """The paths through annotated exons that cover a protein from end to end: gene and the columns of ``weave``."""
    hits = exon_hits(exon_windows(annotations, chunks, sizes, size), proteins)
    return weave(hits, proteins).filter("full").join(proteins.select("seq_id", "gene"), "seq_id")


def best_paths(paths: DataFrame) -> DataFrame:
    """gene, seq_id, method, chr (a label), chimeric, note, exons of each sequence's best path, in the form of ``spliced_maps``."""
    best = paths.groupBy("seq_id").agg(F.min_by(F.struct("gene", "chr", "strand", "exons"), F.struct((-F.col("score")).alias("s"), "chr", "strand", "path")).alias("b")).select("seq_id", "b.*")
    # the first exon counts from its start, the others from their ends, as the codon at a junction belongs to the exon of its first bases
    centres = "transform(sequence(e.a_start, e.a_end), r -> if(k = 0, e.n_start + strand * (3 * (r - e.a_start) + 1), e.n_end - strand * (3 * (e.a_end - r) + 1)))"
    exons = F.expr(f"transform(filter(exons, e -> e.a_end >= e.a_start), (e, k) -> struct(e.a_start as a_start, e.a_end as a_end, chr as chr, strand as strand, e.n_start as n_start, e.n_end as n_end, {centres} as centres))")
    return best.select("gene", "seq_id", F.lit("seed_weave").alias("method"), strand_label(F.col("chr"), F.col("strand")).alias("label"), F.lit(False).alias("chimeric"), F.lit(None).cast("string").alias("note"), exons.alias("exons")).withColumnRenamed("label", "chr")


def _seeded_residues(paths: DataFrame) -> DataFrame:
    """(seq_id, residue, pos) of each sequence's best path: the best score, then the smallest chromosome."""
    best = paths.groupBy("seq_id").agg(F.min_by(F.struct("chr", "strand", "path"), F.struct((-F.col("score")).alias("s"), "chr", "strand", "path")).alias("b")).select("seq_id", "b.*")
    centres = codon_centres(paths.join(best, ["seq_id", "chr", "strand", "path"], "left_semi"))
    return centres.select("seq_id", "residue", (F.col("strand") * F.col("pos")).alias("pos"))


def _with_letters(placed: DataFrame, proteins: DataFrame) -> DataFrame:
    letters = proteins.select("seq_id", "gene", F.posexplode(F.filter(F.split("residues", ""), lambda c: c != "")).alias("residue", "ch"))
    return placed.join(letters, ["seq_id", "residue"]).select("gene", "seq_id", "pos", "ch")


def map_proteins(proteins: DataFrame, annotations: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(mapped residues, misses) of one species, by its annotated exons alone.

    ``proteins``: seq_id, gene, residues.  A mapping must cover the protein from
    end to end and lie on its gene's commonest chromosome; of several the best
    score stays, then the smallest chromosome.
    """
    paths = seed_maps(proteins, annotations, chunks, sizes, size)
    home = canonical(paths.select("gene", "seq_id", "chr").distinct(), ["gene"], "chr")
    good = paths.join(home, "gene").filter("chr = canonical")
    wrong = with_misses(paths.select("seq_id", "gene").distinct(), good, ["seq_id"], "Noncanonical")
    unmapped = with_misses(proteins.select("seq_id", "gene"), paths, ["seq_id"])
    return _with_letters(_seeded_residues(good), proteins), wrong.unionByName(unmapped)


AROUND = 1000


def guided_searches(proteins: DataFrame, annotations: DataFrame, sizes: DataFrame) -> DataFrame:
    """A search for each sequence and chromosome strand of its gene: its annotated exons from first to last, with ``AROUND`` bases more."""
    a = annotations.withColumns({"lo": F.least("start", "end"), "hi": F.greatest("start", "end")})
    span = a.groupBy("gene", "chr", "strand").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).join(sizes, "chr")
    lo, hi = F.greatest(F.col("lo") - AROUND, F.lit(1)), F.least(F.col("hi") + AROUND, F.col("size"))
    nth = F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("n"), "chr", "strand")).cast("long")
    own = span.select("gene", nth.alias("search"), F.lit(1).alias("part"), "chr", F.when(F.col("strand") > 0, lo).otherwise(hi).alias("a"), F.when(F.col("strand") > 0, hi).otherwise(lo).alias("b"))
    return proteins.select("seq_id", "gene").join(own, "gene").drop("gene")


def map_with_search(proteins: DataFrame, annotations: DataFrame, chunks: DataFrame, sizes: DataFrame, size: int = 1 << 16, whole_genome: bool = True) -> tuple[DataFrame, DataFrame]:
    """(maps, misses) of one species, by annotated exons and then by searches; ``mapped_residues`` has the maps' residues.

    What the seeds leave without a full map is aligned to the gene's annotated
    stretch; what is still left, and genes without annotations, to the ranges
    that a translated search of the whole genome leads to.  Of several maps of a
    sequence the one written last counts.  A gene's chromosome is the commonest of
    all its maps; others are misses, Chimeric or Noncanonical, as is what nothing maps.
    Without ``whole_genome`` only annotated stretches are searched.
    """
    paths = kept(seed_maps(proteins, annotations, chunks, sizes, size))
    left = proteins.join(paths.select("seq_id"), "seq_id", "left_anti")
    searches = guided_searches(left, annotations, sizes)
    found = spliced_maps(left, searches, chunks, 90.0, size)
    guided = kept(best_before_stop(found, ["seq_id"], ["search"], "pct_id"))
    rest = kept(left.join(guided.select("seq_id"), "seq_id", "left_anti"))
    hits = kept(translated_search(rest if whole_genome else rest.limit(0), chunks, sizes, size))
    searched = staged_search(rest, hits, chunks, sizes, size).drop("stage")
    spliced = last_written(guided.withColumn("phase", F.lit(2)).unionByName(searched.withColumn("phase", F.lit(3))), ["seq_id"], "phase")
    method = F.when(F.col("phase") == 2, "guided_spliced").otherwise("search_spliced")
    spliced = spliced.join(proteins.select("seq_id", "gene"), "seq_id").select("gene", "seq_id", method.alias("method"), "chr", "chimeric", "note", "exons")

    seeded = paths.withColumn("label", strand_label(F.col("chr"), F.col("strand")))
    label = F.when(F.col("chimeric"), "Chimeric").otherwise(F.col("chr"))
    labels = seeded.select("gene", "seq_id", "label").distinct().unionByName(spliced.select("gene", "seq_id", label.alias("label")))
    home = canonical(labels, ["gene"], "label")
    good = best_paths(seeded.join(home, "gene").filter("label = canonical"))
    maps = good.unionByName(spliced.join(home, "gene").filter("not chimeric and chr = canonical").select(good.columns))

    why = labels.groupBy("gene", "seq_id").agg(F.when(F.every(F.col("label") == "Chimeric"), "Chimeric").otherwise("Noncanonical").alias("reason"))
    wrong = why.join(maps.select("seq_id"), "seq_id", "left_anti").select("seq_id", "gene", "reason")
    unmapped = with_misses(proteins.select("seq_id", "gene"), labels, ["seq_id"])
    return maps, wrong.unionByName(unmapped)


def mapped_residues(maps: DataFrame, proteins: DataFrame) -> DataFrame:
    """gene, seq_id, pos, ch: the residues of maps at the middle bases of their codons, in reading direction."""
    exon = maps.select("seq_id", F.explode("exons").alias("e")).select("seq_id", "e.a_start", "e.strand", F.posexplode("e.centres").alias("k", "at"))
    return _with_letters(exon.select("seq_id", (F.col("a_start") + F.col("k")).alias("residue"), (F.col("strand") * F.col("at")).alias("pos")), proteins)


def add_unmapped(aligned: DataFrame, misses: DataFrame, proteins: DataFrame) -> DataFrame:
    """gene, seq_id, aligned: composed rows with the unmapped added in order of their ids."""
    rows = aligned.select("gene", "seq_id", "aligned").withColumn("step", F.lit(-1).cast("long"))
    rest = misses.join(proteins.select("seq_id", "residues"), "seq_id").select("gene", "seq_id", F.col("residues").alias("aligned"), F.col("seq_id").alias("step"))
    return merge_families(rows.unionByName(rest), "gene", "step", "seq_id", "aligned", final=False, costs=GapCosts(intron_base=0.0)).drop("row_no")


def align_species(mapped: DataFrame, misses: DataFrame, proteins: DataFrame) -> DataFrame:
    """gene, seq_id, aligned: the family composed from coordinates, frame by frame, with the unmapped added in order of their ids."""
    return add_unmapped(compose_frames(mapped, ["gene"], "seq_id"), misses, proteins)


def align_genomeless(proteins: DataFrame, most: int = 30_000) -> DataFrame:
    """gene, seq_id, aligned: families without a genome, aligned one by one in the order of their ids.

    Families of over ``most`` sequences are left out.
    """
    few = proteins.withColumn("n", F.count("*").over(Window.partitionBy("gene"))).filter(F.col("n") <= most)
    rows = few.select("gene", "seq_id", F.col("residues").alias("aligned"), F.col("seq_id").alias("step"))
    return merge_families(rows, "gene", "step", "seq_id", "aligned", final=False, costs=GapCosts(intron_base=0.0)).drop("row_no")


def merge_species(alignments: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """gene, row_no, seq_id, aligned: the species' alignments (species, gene, seq_id, aligned) merged by the steps of a tree.

    Each step merges one clade's alignment into another's within every gene;
    species that no step names join at the end, in order of their names.
    """
    return merge_by_steps(alignments, steps, "gene", "species", "seq_id", "aligned")
