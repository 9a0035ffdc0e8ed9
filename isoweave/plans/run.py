"""A whole run: from proteins, a species guide and genomes to files of maps, misses and alignments.

Below the output folder it leaves

    Final-MSAs/<gene>.afa                          all species' isoforms of a gene
    Species-MSAs/<species>/alignments/<gene>.afa   those of one species, with exon boundaries
    Species-MSAs/<species>/mappings/<gene>.out     maps to the genome
    Mapping-Misses/<species>.misses                what couldn't be mapped, and why

or, for maps only, ``Mappings-by-Gene/<gene>/<species>.mappings``, ``.misses`` and
``.alt-reading-frames``.  Species are mapped one after the other, as each has its own
genome; all genes of a species are one set of jobs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.operators.durable import kept
from isoweave.operators.frames import compose_frames
from isoweave.operators.repair import repair_families
from isoweave.plans.families import add_unmapped, align_genomeless, map_with_search, mapped_residues, merge_species
from isoweave.sources import files
from isoweave.sources.text import checked_guide, chromosome_sizes, merge_steps, read_annotations, read_genome, read_guide, read_proteins

MISC = "misc"


@dataclass(frozen=True)
class RunOptions:
    """``only_map`` ends with the maps; ``search`` looks through whole genomes for what annotated stretches don't give; ``clean`` repairs the final alignments."""

    only_map: bool = False
    search: bool = True
    clean: bool = True
    chunk: int = 1 << 16
    largest_family: int = 30_000


@dataclass
class Species:
    name: str
    proteins: DataFrame
    maps: DataFrame | None
    misses: DataFrame
    labels: DataFrame
    aligned: DataFrame


def _map_species(spark: SparkSession, name: str, genome: str, annotations: str | None, proteins: DataFrame, options: RunOptions) -> Species:
    chunks = kept(read_genome(spark, genome, options.chunk))
    sizes = kept(chromosome_sizes(chunks, options.chunk))
    nothing = "gene string, chr string, strand int, start long, end long, line_no long"
    marks = read_annotations(spark, annotations, sizes) if annotations else spark.createDataFrame([], nothing)
    maps, misses = map_with_search(proteins, marks, chunks, sizes, options.chunk, options.search)
    maps, misses = kept(maps), kept(misses)
    rows = kept(compose_frames(mapped_residues(maps, proteins), ["gene"], "seq_id", clean=options.clean))
    aligned = rows.select("gene", "seq_id", "aligned")
    if not options.only_map:
        aligned = kept(add_unmapped(aligned, misses, proteins))
    return Species(name, proteins, maps, misses, rows.select("seq_id", "label").filter("label is not null"), aligned)


def _genomeless(proteins: DataFrame, options: RunOptions) -> Species:
    aligned = kept(align_genomeless(proteins, options.largest_family))
    misses = proteins.select("seq_id", "gene", F.lit("No genome").alias("reason"))
    labels = proteins.select("seq_id", F.lit(None).cast("string").alias("label")).limit(0)
    return Species(MISC, proteins, None, misses, labels, aligned)


def _write_species(s: Species, out: str, options: RunOptions) -> None:
    names = s.proteins.select("seq_id", "orig_name")
    gene = F.col("gene")
    misses = files.named_rows(s.misses, names)
    files.write_files(files.miss_files(misses, files.file_name("Mapping-Misses", F.lit(f"{s.name}.misses"))), out)
    maps = files.named_rows(s.maps, names) if s.maps is not None else None
    if options.only_map:
        by_gene = lambda kind: files.file_name("Mappings-by-Gene", gene, F.lit(f"{s.name}.{kind}"))
        if maps is not None:
            files.write_files(files.mapping_files(maps, by_gene("mappings")), out)
        files.write_files(files.miss_files(misses, by_gene("misses")), out)
        framed = files.named_rows(s.labels.join(s.proteins.select("seq_id", "gene"), "seq_id"), names)
        files.write_files(files.frame_files(framed, by_gene("alt-reading-frames")), out)
        return
    folder = ("Species-MSAs", F.lit(s.name))
    if maps is not None:
        files.write_files(files.mapping_files(maps, files.file_name(*folder, "mappings", F.concat(gene, F.lit(".out"))), F.get("exons", 0)["chr"]), out)
    rows = files.named_rows(s.aligned.withColumn("row_no", F.col("seq_id")).join(s.proteins.select("seq_id", F.col("original").alias("residues")), "seq_id"), names, s.labels)
    files.write_files(files.alignment_files(files.restore_case(rows), files.file_name(*folder, "alignments", F.concat(gene, F.lit(".afa")))), out)


def run(spark: SparkSession, proteins_path: str, guide_path: str, out: str, options: RunOptions = RunOptions()) -> list[str]:
    """Run everything and return the names of the species that had sequences."""
    guide_text = spark.read.text(guide_path, wholetext=True).first()
    tree, guide = read_guide(guide_text.value if guide_text else "")
    guide = checked_guide(spark, guide)
    proteins = kept(read_proteins(spark, proteins_path))
    known = [name for name, *_ in guide]
    proteins = proteins.withColumn("species", F.when(F.col("species").isin(known), F.col("species")).otherwise(MISC))
    have = {r.species for r in proteins.select("species").distinct().collect()}  # those of the guide, and one more
    done = [_map_species(spark, name, genome, marks, proteins.filter(F.col("species") == name), options) for name, genome, marks in guide if name in have]
    if MISC in have and not options.only_map:
        done.append(_genomeless(proteins.filter(F.col("species") == MISC), options))
    for s in done:
        _write_species(s, out, options)
    if done and not options.only_map:
        rows = reduce(DataFrame.unionByName, [s.aligned.withColumn("species", F.lit(s.name)) for s in done])
        labels = reduce(DataFrame.unionByName, [s.labels for s in done])
        merged = kept(merge_species(rows, merge_steps(tree, [s.name for s in done])))
        if options.clean:
            fixed = repair_families(merged, ["gene"], "row_no")
            merged = merged.drop("aligned").join(fixed, ["gene", "row_no"])
        final = files.named_rows(merged.join(proteins.select("seq_id", F.col("original").alias("residues")), "seq_id"), proteins, labels)
        files.write_files(files.alignment_files(files.restore_case(final), files.file_name("Final-MSAs", F.concat("gene", F.lit(".afa")))), out)
    return [s.name for s in done]
