"""URL filters: allow and block rules, and gradient-boosted trees where no rule speaks.

A rule is a host and the start of a path.  It fits its host and all subdomains
where the url's path begins as the rule's does; of the rules that fit, the longest
gives the verdict.  Urls that a rule judges are the labelled ones: from them
Spark's gradient-boosted trees learn, on lexical features, to judge the rest.

Features: lengths (url, host, path, query, longest host label and path segment),
depths of host and path, shares of digits, character entropies, parameter counts,
marks, and suffix statistics.  Those are the smoothed share of blocked urls and
their number for the last label of the host, its last two labels and the first
directory, counted over all labelled urls; a url that the trees learn from is left
out of its own, as each of ``FOLDS`` parts of the labelled urls sees the counts of
the others.  Values under ``LEAST`` labelled urls count as unseen.

The trees are fitted on about ``PER_LABEL`` urls a label, chosen by a hash of the
url and weighted to the labels' true counts.  Features, counts and scores are
expressions and joins in the JVM; statistics meet the urls in joins that Spark
broadcasts when they are small and otherwise splits where a value is frequent.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the model; a url is judged alone, so repeated rows get
equal verdicts; where rules label no url, or all alike, the model's verdict is that
label, or allow; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need

PER_LABEL, FOLDS, LEAST, PRIOR_WEIGHT = 20_000, 5, 5, 10.0
TREES, DEPTH, STEP = 20, 4, 0.25
ALLOW, BLOCK = "allow", "block"

_HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? or #, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST_PATH, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


def matching_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits, or nulls; of equal ones the first.  For lists that one expression can hold."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(reversed(rules), key=lambda r: len(r[0])):  # the longest ends up outermost
        at = rule.find("/") if "/" in rule else len(rule)
        own = rule[:at].lower()
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(rule[at:])
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def _entropy(text: str) -> str:
    """SQL of the bits a character of a text, from its own character counts."""
    n = f"(length({text}) - length(replace({text}, c, '')))"
    sums = f"aggregate(array_distinct(regexp_extract_all({text}, '(?s).', 0)), 0D, (s, c) -> s + {n} * log2({n}))"
    return f"if({text} = '', 0D, log2(length({text})) - {sums} / length({text}))"


_DIGITS = "(length({0}) - length(translate({0}, '0123456789', '')))"
_LONGEST = "coalesce(array_max(transform(split({0}, '{1}'), x -> length(x))), 0)"
#: Feature by feature, over url, host, path and query (never null).
LEXICAL = {
    "url_length": "length(url)",
    "host_length": "length(host)",
    "path_length": "length(path)",
    "query_length": "length(query)",
    "longest_label": _LONGEST.format("host", "[.]"),
    "longest_segment": _LONGEST.format("path", "/"),
    "host_depth": "size(filter(split(host, '[.]'), x -> x <> ''))",
    "path_depth": "size(filter(split(path, '/'), x -> x <> ''))",
    "digit_ratio": f"{_DIGITS.format('url')} / greatest(length(url), 1)",
    "path_digit_ratio": f"{_DIGITS.format('path')} / greatest(length(path), 1)",
    "url_entropy": _entropy("url"),
    "host_entropy": _entropy("host"),
    "n_params": "size(filter(split(query, '[&;]'), x -> x <> ''))",
    "n_values": "length(query) - length(replace(query, '=', ''))",
    "n_marks": "length(url) - length(translate(url, '-_.~%', ''))",
    "has_fragment": "if(contains(url, '#'), 1, 0)",
    "is_https": "if(startswith(url, 'https:'), 1, 0)",
    "ends_in_slash": "if(endswith(path, '/'), 1, 0)",
}
#: Parts of a url that suffix statistics are kept of.
PARTS = {
    "last_label": "regexp_extract(host, '([^.]*)$', 1)",
    "last_labels": "regexp_extract(host, '([^.]*[.]?[^.]*)$', 1)",
    "first_directory": "regexp_extract(path, '^/([^/]*)/', 1)",
}
FEATURES = [*LEXICAL, *(f"{p}_{what}" for p in PARTS for what in ("blocked", "seen"))]


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds query, all ``LEXICAL`` features and the ``PARTS`` to rows of (url, host, path)."""
    with_query = urls.withColumn("query", F.regexp_extract("url", r"^[^?#]*\?([^#]*)", 1))
    return with_query.select("*", *[F.expr(f"cast({sql} as double)").alias(name) for name, sql in LEXICAL.items()], *[F.expr(sql).alias(name) for name, sql in PARTS.items()])


def part_statistics(labelled: DataFrame, part: str) -> DataFrame:
    """(part, n, blocked, folds) for each value that ``LEAST`` labelled urls hold; ``folds`` has the counts of each fold."""
    folds = labelled.groupBy(part, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    whole = folds.groupBy(part).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "blocked")))).alias("folds"))
    return whole.filter(F.col("n") >= LEAST)  # a row holds FOLDS entries at most


def with_statistics(rows: DataFrame, statistics: dict[str, DataFrame], share: float, out_of_fold: bool) -> DataFrame:
    """Adds each part's share of blocked urls, drawn to the overall ``share``, and the logarithm of their number."""
    for part, known in statistics.items():
        rows = rows.join(known, part, "left")
        own = F.col("folds")[F.col("fold")] if out_of_fold else F.lit(None)
        n, blocked = [F.coalesce(F.col(c), F.lit(0)) - (F.coalesce(own[c], F.lit(0)) if out_of_fold else F.lit(0)) for c in ("n", "blocked")]
        rows = rows.withColumns({f"{part}_blocked": (blocked + PRIOR_WEIGHT * share) / (n + PRIOR_WEIGHT), f"{part}_seen": F.log1p(n.cast("double"))}).drop("n", "blocked", "folds")
    return rows


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


class UrlModel:
    """The fitted trees with the statistics they need; or one label for all, where there was nothing to tell apart."""

    def __init__(self, trees: Model | None, statistics: dict[str, DataFrame], share: float):
        self.trees, self.statistics, self.share = trees, statistics, share

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds p_block to rows of (url, host, path)."""
        if self.trees is None:
            return rows.withColumn("p_block", F.lit(float(self.share > 0.5)))
        found = with_statistics(lexical_features(rows), self.statistics, self.share, out_of_fold=False)
        scored = self.trees.transform(_vectors(found))
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p_block"))


def fit_urls(labelled: DataFrame, work: Workspace, *, per_label: int = PER_LABEL, trees: int = TREES, seed: int = 1) -> UrlModel:
    """Learn from rows of (url, host, path, label), label 1 for blocked."""
    found = lexical_features(labelled).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return UrlModel(None, {}, share)
    statistics = {p: work.save(part_statistics(found, p), p) for p in PARTS}
    draw = F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    kept = F.when(F.col("label") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    sample = found.filter(draw < kept).withColumn("weight", 1 / kept)
    rows = _vectors(with_statistics(sample, statistics, share, out_of_fold=True)).select("features", "label", "weight")
    table = work.save(rows.withColumn("label", F.col("label").cast("double")), "train")
    learner = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=STEP, maxBins=64, seed=seed, weightCol="weight")
    return UrlModel(learner.fit(table), statistics, share)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5, per_label: int = PER_LABEL) -> DataFrame:
    """id_col, host, path, rule (null where none fits), verdict and p_block (null where a rule speaks) of every row."""
    need(pages, id_col, url_col)
    work = Workspace(pages.sparkSession, "url_filter")
    urls = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, says = matching_rule(rules, F.col("host"), F.col("path"))
    judged = work.save(urls.withColumns({"rule": rule, "says": says}), "urls")
    labelled = judged.filter("says is not null").select("url", "host", "path", (F.col("says") == BLOCK).cast("int").alias("label"))
    model = fit_urls(labelled, work, per_label=per_label)
    open_ = model.score(judged.filter("says is null").select("id", "url", "host", "path"))
    by_model = open_.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("p_block") > cut, BLOCK).otherwise(ALLOW).alias("verdict"), "p_block")
    by_rule = judged.filter("says is not null").select("id", "host", "path", "rule", F.col("says").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    return by_rule.unionByName(by_model).withColumnRenamed("id", id_col)
