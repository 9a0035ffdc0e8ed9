"""Source divergence audit: how the words of each source of a language differ from those of the others.

Terms are runs of letters (A-Z in lower case, and everything beyond ASCII).  A
language keeps the terms that ``min_docs`` of its documents hold.  Each source
of a language, and the language as a whole, gives every kept term the smoothed
share p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two shares differ by
floor((p - q)^2 / (p + q)).  Part ``pair`` sums that over all kept terms for each
two sources of a language; part ``term`` lists each source's most overused terms
against the language.

Method: one pass counts (lang, source, term) in Arrow batches, summed up in each
task before they meet; a kept term is then pivoted into one array with a place for
each source of its language, higher order functions of the JVM emit what the term
adds to each two sources, and partial aggregation sums that in each task before
anything is shuffled.  All of it is on integers.  No join or window has the language alone for its key:
terms meet their language's sources under a salt, and top lists are cut in each
task before they meet.  A row holds a few numbers for each source of its language.

Defined cases: a null text, lang or source is ''; a language without kept terms
has pairs of value 0 and no terms; a source without terms is a group like any
other, and one alone in its language has no pairs; every row is a document of
its own, repeated or not; ties are ranked by the UTF-8 bytes of the item; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need, word_lists

#: Bytes of text read together, and terms that a task holds before it passes its counts on.
PIECE, FLUSH = 1 << 20, 500_000
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
SCALE, SMOOTH = 1_000_000_000, 2
#: SCALE times a count up to this fits a long; beyond it decimals carry the product.
_FITS = 9_000_000_000


def _groups(docs: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    named = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return docs.withColumns({"__lang": named(lang_col, "__lang"), "__source": named(source_col, "__source")})


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        many = [len(c) for c in held.values()]
        named = lambda k: pa.array(np.repeat(np.array([g[k] for g in held], object), many), pa.string())
        terms = [t for c in held.values() for t in c]
        n = [counts[g][t] for g, c in held.items() for t in c]
        return pa.RecordBatch.from_pydict({"lang": named(0), "source": named(1), "term": pa.array(terms, pa.binary()), "n": pa.array(n, pa.int64()), "docs": pa.array([d for c in held.values() for d in c.values()], pa.int64())})

    counts, held = defaultdict(Counter), defaultdict(Counter)
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs, own = counts[lang, source], held[lang, source], set()
            before = len(docs)
            for words in word_lists(text, _LETTERS, PIECE):
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(docs) - before
            if size > FLUSH:
                yield out()
                counts, held, size = defaultdict(Counter), defaultdict(Counter), 0
    yield out()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): a term's occurrences in a source, and the documents there that hold it."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = _groups(docs, lang_col, source_col).select("__lang", "__source", text).mapInArrow(_partial, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> str:
    """SQL of 1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH * n_terms)), exact at any size."""
    c, d = f"({count} + {SMOOTH})", f"({total} + {SMOOTH} * n_terms)"
    return f"1 + if({c} <= {_FITS}, ({SCALE} * {c}) div {d}, (cast({SCALE} as decimal(10, 0)) * cast({c} as decimal(19, 0))) div {d})"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _languages(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, n_terms, total, sources): a language's kept terms, their occurrences, and those in each source by name."""
    groups = _groups(docs, lang_col, source_col).select(F.col("__lang").alias("lang"), F.col("__source").alias("source")).distinct()
    sums = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("n_terms"))
    each = groups.join(sums, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    out = each.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"), F.sum("total").alias("total"))
    return out.join(terms, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("long")))


def _vectors(kept: DataFrame, langs: DataFrame, salts: int) -> DataFrame:
    """(lang, term, q, cells): a place for each source of the language, with the term's count and share there."""
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"])
    met = met.withColumn("q", F.expr(_share("aggregate(cells, 0L, (s, c) -> s + c.n)", "total"))).withColumn("found", F.map_from_entries("cells"))
    counted = met.withColumn("cells", F.expr("transform(sources, s -> struct(s.source as source, s.total as total, coalesce(try_element_at(found, s.source), 0L) as n))"))
    return counted.select("lang", "term", "q", F.expr(f"transform(cells, c -> struct(c.source as source, c.n as n, {_share('c.n', 'c.total')} as p))").alias("cells"))


def _pairs(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each source and each other one of its language."""
    shares = vectors.select("lang", F.col("cells.p").alias("p"))
    first = shares.select("lang", "p", F.posexplode("p").alias("i", "a"))  # one source against all later ones: a row stays as long as the vector
    added = first.select("lang", "i", F.posexplode(F.expr(f"transform(slice(p, i + 2, size(p)), b -> {_apart('a', 'b')})")).alias("gap", "value"))
    sums = added.groupBy("lang", "i", "gap").agg(F.sum("value").alias("value"))
    one = langs.select("lang", "sources", F.posexplode("sources").alias("k", "own"))
    each = one.select("lang", F.col("own.source").alias("source"), "k", F.posexplode("sources").alias("j", "other")).filter("j <> k")
    named = each.select("lang", "source", F.col("other.source").alias("item"), F.least("k", "j").alias("i"), (F.abs(F.col("k") - F.col("j")) - 1).alias("gap"))
    return named.join(sums, ["lang", "i", "gap"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def source_divergence(docs: DataFrame, *, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all pairs of sources of a language, and ``top`` overused terms of each source."""
    need(docs, lang_col, source_col, text_col)
    work = Workspace(docs.sparkSession, "source_audit")
    counts = work.save(term_counts(docs, lang_col, source_col, text_col), "counts")
    held = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))  # one entry a source
    kept = work.save(held.filter(F.col("docs") >= min_docs).select("lang", "term", "cells"), "kept")
    work.drop("counts")
    langs = work.save(_languages(docs, kept, lang_col, source_col), "languages")
    vectors = _vectors(kept, langs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(vectors, langs).withColumn("rank", F.row_number().over(order))
    over = vectors.select("lang", F.col("term").alias("item"), "q", F.inline("cells")).filter("n > 0 and p > q")
    terms = over.select("lang", "source", "item", F.expr(_apart("p", "q")).alias("value")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
