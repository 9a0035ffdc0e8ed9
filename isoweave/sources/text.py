"""Readers of the text formats: FASTA, gene annotations, aliases, guides, search hits, trees."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoweave.functions.bio import reverse_complement
from isoweave.operators.intervals import first_per_key
from isoweave.operators.names import parse_headers
from isoweave.sources.files import numbered


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """header, sequence: one row per record, white space out of the sequence."""
    return _records(spark.read.option("lineSep", "\n>").text(path)).filter("header <> ''")


def _records(text: DataFrame) -> DataFrame:
    rec = text.withColumn("value", F.regexp_replace("value", r"^>", ""))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"(?m)^\s+#.*$", "")
    return rec.withColumns({"header": F.trim(F.regexp_extract("value", r"^([^\n\r]*)", 1)), "sequence": F.regexp_replace(body, r"\s", "")}).drop("value")


def read_proteins(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, orig_name, species, gene, aliases, iso_id, comment, residues, in the order of the files; names that fit no dialect are left out."""
    text = spark.read.option("lineSep", "\n>").text(path).filter(F.regexp_replace("value", r"^>", "").rlike(r"^[^\n\r]*[^\s]"))
    rows = parse_headers(_records(numbered(text)))
    rows = rows.filter("dialect <> 'reject'").withColumn("residues", F.upper("sequence"))
    return rows.select("seq_id", F.col("header").alias("orig_name"), "species", "gene", "aliases", "iso_id", "comment", F.col("sequence").alias("original"), "residues")


def chromosome_sizes(chunks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """chr, size: the lengths of a genome's chromosomes, from its chunks."""
    return chunks.groupBy("chr").agg(F.max(F.col("chunk") * size + F.length("seq")).cast("long").alias("size"))


def read_genome(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    """chr, chunk, seq of a genome FASTA; a chromosome's name is its header's first word."""
    return chunked(read_fasta(spark, path).select(F.regexp_extract("header", r"^(\S+)", 1).alias("chr"), "sequence"), size)


def chunked(genome: DataFrame, size: int = 1 << 16) -> DataFrame:
    """chr, chunk, seq: a genome (chr, sequence) in chunks of ``size`` bases."""
    n = F.floor((F.length("sequence") - 1) / size)
    return genome.filter("length(sequence) > 0").select("chr", "sequence", F.explode(F.sequence(F.lit(0), n)).alias("chunk")).select("chr", "chunk", F.substr(F.col("sequence"), (F.col("chunk") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def fetch(chunks: DataFrame, ranges: DataFrame, size: int = 1 << 16, keys: list[str] | None = None) -> DataFrame:
    """``ranges`` (keys, chr, a, b; from 1, both ends in) with their bases; a > b reads the other strand."""
    keys = keys or ["range_id"]
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    need = ranges.withColumn("chunk", F.explode(F.sequence(F.floor((lo - 1) / size), F.floor((hi - 1) / size))))
    part = need.join(chunks, ["chr", "chunk"])
    at = (F.greatest(lo - F.col("chunk") * size, F.lit(1))).cast("int")
    upto = F.least(hi - F.col("chunk") * size, F.length("seq")).cast("int")
    part = part.withColumn("piece", F.substr(F.col("seq"), at, upto - at + 1))
    own = F.array_sort(F.collect_list(F.struct("chunk", "piece")))
    got = part.groupBy(*keys, "chr", "a", "b").agg(F.array_join(F.transform(own, lambda x: x["piece"]), "").alias("s"))
    return got.withColumn("nucls", F.when(F.col("a") > F.col("b"), reverse_complement(F.col("s"))).otherwise(F.col("s"))).drop("s")


def known_chromosome(entries: DataFrame, sizes: DataFrame, label: str = "label") -> DataFrame:
    """``entries`` whose label names a chromosome of ``sizes`` (chr), as it is or with ``chr`` before it; adds chr."""
    a = sizes.select(F.col("chr").alias("__a"))
    b = sizes.select(F.col("chr").alias("__b"))
    met = entries.join(a, F.col(label) == F.col("__a"), "left").join(b, F.concat(F.lit("chr"), F.col(label)) == F.col("__b"), "left")
    return met.withColumn("chr", F.coalesce("__a", "__b")).filter("chr is not null").drop("__a", "__b")


def read_annotations(spark: SparkSession, path: str, sizes: DataFrame) -> DataFrame:
    """gene, chr, strand, start, end, line_no: exons and coding stretches, each place once, under the first gene.

    Reverse ranges start at the greater place.
    """
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id()).filter(~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    rows = text.filter(F.size(f) >= 9).select("line_no", F.get(f, 0).alias("label"), F.lower(F.get(f, 2)).alias("type"), F.get(f, 3).cast("long").alias("lo"), F.get(f, 4).cast("long").alias("hi"), F.get(f, 6).alias("sign"), F.lower(F.regexp_extract(F.get(f, 8), 'gene_name "([^"]+)"', 1)).alias("gene"))
    rows = known_chromosome(rows.filter(F.col("type").isin("exon", "cds") & (F.col("gene") != "")), sizes)
    back = F.col("sign") == "-"
    rows = rows.select("gene", "chr", F.when(back, -1).otherwise(1).alias("strand"), F.when(back, F.col("hi")).otherwise(F.col("lo")).alias("start"), F.when(back, F.col("lo")).otherwise(F.col("hi")).alias("end"), "line_no")
    return first_per_key(rows, ["chr", "strand", "start", "end"], ["line_no"])


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """alias, primary: each line is a gene and its other names, between white space."""
    w = F.filter(F.split(F.lower("value"), r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(w.alias("w")).filter("size(w) > 1")
    return rows.select(F.get("w", 0).alias("primary"), F.explode(F.slice("w", F.lit(2), F.size("w") - 1)).alias("alias")).select("alias", "primary").distinct()


def read_search_hits(spark: SparkSession, path: str) -> DataFrame:
    """The twelve tab-separated columns of a translated search."""
    return spark.read.csv(path, sep="\t", schema="seq_id string, chr string, pct double, len int, mism int, gaps int, a_start int, a_end int, n_start long, n_end long, evalue double, score double")


def repaired_tree(text: str) -> str:
    """A Newick tree with the commas that it lacks between clades, and between a clade and a name; closed within one pair of parentheses."""
    text = re.sub(r"\s+", " ", text.strip().rstrip(";"))
    text = re.sub(r"\s*([(),])\s*", r"\1", text)
    text = re.sub(r"\)\(", "),(", text)
    text = re.sub(r"([^(),])\(", r"\1,(", text)
    text = re.sub(r"(?<=[^(),:]) (?=[^(),:])", ",", text)
    if text.count("(") != text.count(")"):
        raise ValueError(f"{text.count('(')} opening and {text.count(')')} closing parentheses")
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise ValueError(f"a parenthesis closes at {k} that none opened")
        if depth == 0 and c == ",":
            return f"({text})"
    return text


def checked_guide(spark: SparkSession, rows: list[tuple[str, str, str | None]], home: str | None = None) -> list[tuple[str, str, str | None]]:
    """A guide's rows with ``~`` as the home folder; an error names every file that doesn't exist, and species listed twice."""
    home = home or os.path.expanduser("~")
    out = [(name, *(None if p is None else home + p[1:] if p == "~" or p.startswith("~/") else p for p in paths)) for name, *paths in rows]
    context = spark.sparkContext

    def there(path: str) -> bool:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)

    wrong = [f"{name}: no file {p}" for name, *paths in out for p in paths if p is not None and not there(p)]
    names = [name for name, *_ in out]
    wrong += sorted({f"{n}: listed twice" for n in names if names.count(n) > 1})
    if wrong:
        raise ValueError("; ".join(wrong))
    return out


def species_names(spark: SparkSession, path: str) -> DataFrame:
    """latin, english: a file of ``latin = english`` lines, in lower case with ``_`` for blanks."""
    parts = F.regexp_extract("value", r"^\s*([^=]+?)\s*=\s*([^=]+?)\s*$", 1), F.regexp_extract("value", r"^\s*([^=]+?)\s*=\s*([^=]+?)\s*$", 2)
    named = [F.regexp_replace(F.lower(p), r"\s", "_") for p in parts]
    return spark.read.text(path).select(named[0].alias("latin"), named[1].alias("english")).filter("latin <> ''").distinct()


def in_english(df: DataFrame, names: DataFrame, species: str = "species") -> DataFrame:
    """``df`` with Latin species names in English where ``names`` has them."""
    met = df.join(names, F.col(species) == F.col("latin"), "left")
    return met.withColumn(species, F.coalesce("english", species)).select(*df.columns)


def guide_text(guide: DataFrame, tree: str | None = None) -> str:
    """The guide file of (species, genome_path, gtf_path or null): the tree, then a line a species, names padded to one width."""
    width = F.max(F.length("species")).over(Window.partitionBy())
    rows = guide.withColumn("w", width).select(F.expr("rpad(species, w, ' ')").alias("s"), "genome_path", F.coalesce("gtf_path", F.lit("-")).alias("g")).orderBy("s").collect()  # a row a species
    return "\n".join([*([tree] if tree else []), *(f"{r.s}  {r.genome_path}  {r.g}" for r in rows)]) + "\n"


def read_guide(text: str) -> tuple[str | None, list[tuple[str, str, str | None]]]:
    """(tree or None, rows of species, genome, annotations or None) of a species guide."""
    tree, rows = None, []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith("("):
            tree = line
        elif len(f := line.split()) >= 2:
            rows.append((f[0].lower(), f[1], None if len(f) < 3 or f[2] == "-" else f[2]))
    return tree, rows


def _tree(text: str) -> list | str:
    """A Newick tree as nested lists of lower-case leaf names."""
    if text.count("(") != text.count(")"):
        raise ValueError("parentheses don't match")
    top: list = []
    open_lists, closed = [top], False
    for token in re.findall(r"[(),;]|[^(),;\s]+", repaired_tree(text)):
        if token == "(":
            open_lists[-1].append([])
            open_lists.append(open_lists[-1][-1])
        elif token == ")":
            if len(open_lists) == 1:
                raise ValueError("parentheses don't match")
            open_lists.pop()
        elif token not in ",;" and not closed:  # what follows a closed clade is its name or length
            open_lists[-1].append(token.split(":")[0].strip("'\"").lower())
        closed = token == ")"
    return top


def merge_steps(tree: str | None, species: list[str]) -> list[tuple[str, str]]:
    """(into, from) pairs: the species alignments to merge, in an order in which each clade is whole before it joins another.

    A merged clade goes by the name of its first species.  Species that the tree
    doesn't name follow in order of their names, and ``misc`` is last.  Names in
    the tree that aren't in ``species`` are passed over.
    """
    steps: list[tuple[str, str]] = []

    def merged(names: list[str | None]) -> str | None:
        held = [n for n in names if n is not None]
        steps.extend((held[0], n) for n in held[1:])
        return held[0] if held else None

    def clade(node: list | str) -> str | None:
        if isinstance(node, list):
            return merged([clade(x) for x in node])
        return node if node in species and node not in seen and not seen.add(node) else None

    seen: set[str] = {"misc"}
    root = clade(_tree(tree)) if tree else None
    merged([root, *sorted(set(species) - seen), "misc"])
    return steps
