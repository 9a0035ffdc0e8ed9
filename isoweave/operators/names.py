"""Sequence names: header dialects, projections, unique ids, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Characters that names may not hold become ``_``; square brackets become round ones."""
    return F.translate(F.regexp_replace(F.trim(c), r"[\s#&/$|]", "_"), "[]", "()")


def strip_comment(header: Column) -> tuple[Column, Column]:
    """(name, comment): the parts before and after the first ``#``, trimmed; no comment is null."""
    name, rest = F.trim(F.regexp_extract(header, r"^([^#]*)", 1)), F.trim(F.regexp_extract(header, r"^[^#]*#(.*)$", 1))
    return name, F.when(rest != "", rest)


def is_simple(name: Column) -> Column:
    return name.rlike(r"^[^|]+\|[^|]+\|[^|]+\s*$")


def is_uniprot(name: Column) -> Column:
    return name.contains("OS=") & name.contains("GN=")


def uniprot_field(name: Column, key: str) -> Column:
    """The value of ``key=``, up to the next two-letter key."""
    return F.trim(F.regexp_extract(name, key + r"=(.*?)(?:\s[A-Z]{2}=|$)", 1))


def verbose_field(name: Column, key: str) -> Column:
    """The value of ``key:`` in the spelled-out dialect."""
    return F.trim(F.regexp_extract(name, rf"(?i)\b{key}\s*:\s*(.*?)(?=\s+\w+\s*:|$)", 1))


def parse_headers(df: DataFrame, header: str = "header") -> DataFrame:
    """Adds dialect, species, gene, aliases, iso_id, comment; dialect is 'reject' if nothing fits.

    Species and gene are in lower case.  The simplified dialect may name several
    genes with ``/``: the first is the gene, all are aliases.
    """
    name, comment = strip_comment(F.col(header))
    out = df.withColumns({"__name": name, "comment": comment})
    n = F.col("__name")
    simple, verbose = F.split(n, r"\|"), n.rlike(r"(?i)\bspecies\s*:.*\bgene\s*:")
    dialect = F.when(is_uniprot(n), "uniprot").when(is_simple(n), "simple").when(verbose, "verbose").otherwise("reject")
    out = out.withColumn("dialect", dialect)
    d = F.col("dialect")
    species = F.when(d == "uniprot", uniprot_field(n, "OS")).when(d == "simple", F.get(simple, 0)).when(d == "verbose", verbose_field(n, "species"))
    genes = F.when(d == "uniprot", uniprot_field(n, "GN")).when(d == "simple", F.get(simple, 1)).when(d == "verbose", verbose_field(n, "gene"))
    iso = F.when(d == "simple", F.trim(F.get(simple, 2))).when(d == "verbose", verbose_field(n, "id")).when(d == "uniprot", F.regexp_extract(n, r"^[a-z]{2}\|([^|]+)\|", 1))
    names = F.transform(F.split(F.lower(genes), "/"), clean)
    return out.withColumns({"species": clean(F.lower(species)), "gene": F.get(names, 0), "aliases": names, "iso_id": F.when(iso != "", clean(iso))}).drop("__name")


def unique_ids(df: DataFrame, keys: list[str], id_col: str, order: list[str], out: str = "unique_id") -> DataFrame:
    """An id for each row, unique within ``keys``: the given one, then with .1, .2, ...; without one, 1, 2, ...

    The first row that gives an id keeps it, whatever others are made: a made id
    that some row gives itself passes on to the next number that nobody gives.
    """
    own = F.col(id_col).cast("string")
    nth = F.row_number().over(Window.partitionBy(*keys, own).orderBy(*order))
    rows = df.withColumn("__own", own).withColumn("__nth", nth)
    # the numbers that literal ids take: of 7.2 the number 2 of 7, of 3 the number 3 of none
    literal = df.filter(own.isNotNull()).select(*keys, own.alias("__id")).distinct()
    dotted = literal.filter(F.col("__id").rlike(r"^.*\.[1-9][0-9]{0,8}$")).select(*keys, F.regexp_extract("__id", r"^(.*)\.[0-9]+$", 1).alias("__own"), F.regexp_extract("__id", r"\.([0-9]+)$", 1).cast("long").alias("__taken"))
    plain = literal.filter(F.col("__id").rlike("^[1-9][0-9]{0,8}$")).select(*keys, F.lit(None).cast("string").alias("__own"), F.col("__id").cast("long").alias("__taken"))
    taken = dotted.unionByName(plain).groupBy(*keys, "__own").agg(F.array_sort(F.collect_list("__taken")).alias("__taken"))
    met = rows.alias("r").join(taken.alias("t"), [*[F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], F.col("r.__own").eqNullSafe(F.col("t.__own"))], "left").select("r.*", "t.__taken")
    # the k-th number that isn't taken: each taken one up to it moves it on
    k = F.when(F.col("__own").isNull(), F.col("__nth")).otherwise(F.col("__nth") - 1).cast("long")
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), k, lambda n, x: F.when(x <= n, n + 1).otherwise(n))
    made = F.when(F.col("__own").isNull(), free.cast("string")).when(F.col("__nth") == 1, F.col("__own")).otherwise(F.concat("__own", F.lit("."), free.cast("string")))
    return met.withColumn(out, made).drop("__own", "__nth", "__taken")


def alias_lists(df: DataFrame, gene: str, alias: str) -> DataFrame:
    """Per gene its distinct other names, sorted, as an array."""
    return df.groupBy(gene).agg(F.array_sort(F.collect_set(F.when(F.col(alias) != F.col(gene), F.col(alias)))).alias("aliases"))


def expand_aliases(entries: DataFrame, aliases: DataFrame, gene: str = "gene") -> DataFrame:
    """``entries`` also under the primary genes that ``aliases`` (alias, primary) gives; each pair once."""
    more = entries.join(aliases, F.col(gene) == F.col("alias")).withColumn(gene, F.col("primary")).select(*entries.columns)
    return entries.unionByName(more).distinct()
