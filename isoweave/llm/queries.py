"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm.class_lm import score_texts
from isoweave.llm.common import crc_mod
from isoweave.llm.decontaminate import find_contamination
from isoweave.llm.jaccard_join import jaccard_components
from isoweave.llm.line_dedup import dedup_lines
from isoweave.llm.near_vectors import near_vectors
from isoweave.llm.packing import pack
from isoweave.llm.quality import classify_quality
from isoweave.llm.resampling import resample
from isoweave.llm.secrets import count_of, find_secrets, spans_text
from isoweave.llm.source_audit import source_divergence
from isoweave.llm.token_records import token_records
from isoweave.llm.toxicity import fit_toxicity, score_toxicity
from isoweave.llm.url_filter import ALLOW, BLOCK, filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


OP10_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as n
  from documents),
k as (
  select doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
o as (
  select key, min(doc_id) as owner, count(distinct doc_id) as docs
  from k where length(key) >= 10 group by key),
m as (
  select k.doc_id, k.n, k.line, coalesce(o.docs >= 2 and k.doc_id <> o.owner, false) as gone
  from k left join o on k.key = o.key and length(k.key) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""


@query("op10_line_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_token_records")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_records(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_pattern_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_credential_linking")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.concat("base", "linked")).alias("spans"),
    )


@query("op1_neighbour_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = classify_quality(docs, labels, keep=crc_mod("id", 4) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


@query("op9_ordinal_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", "severity", "p_toxic", "grade", "rejected")


OP8_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v),
p as (
  select a.vec_id as a, b.vec_id as b from u a join u b
    on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach(a, b) as (
  select vec_id, vec_id from embeddings
  union select r.a, p.b from reach r join p on r.b = p.a),
c as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from p group by a)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c on e.vec_id = c.a left join n on e.vec_id = n.a
"""


@query("op8_cross_polytope", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op2_simhash_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return find_contamination(docs, items)


@query("op4_class_bigrams")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held_out="crc32(coalesce(cast(doc_id as string), '')) % 5 = 1")


OP6_SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws
  from documents),
s as (
  select doc_id, case when len(ws) = 0 then []
    when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    end as sh
  from w),
u as (select doc_id, len(sh) as n, unnest(sh) as k from s),
p as (
  select a.doc_id as a, b.doc_id as b
  from u a join u b on a.k = b.k and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) as (
  select doc_id, doc_id from documents
  union select r.a, p.b from reach r join p on r.b = p.a),
c as (select a, min(b) as component_id from reach group by a)
select s.doc_id, len(s.sh) as n_shingles, c.component_id from s join c on s.doc_id = c.a
"""


@query("op6_token_combinations", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=90)


OP11_SQL = """
with d as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents),
g as (select distinct lang, source from d),
t as (select k, lang, source, unnest(regexp_extract_all(body, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
c as (select lang, source, term, count(*) as n from t group by all),
kept as (select lang, term from t group by lang, term having count(distinct k) >= 10),
v as (select lang, count(*) as n_terms from kept group by lang),
cell as (
  select g.lang, g.source, kept.term, coalesce(c.n, 0)::hugeint as n
  from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
whole as (select lang, term, sum(n)::hugeint as n from cell group by lang, term),
p as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * n_terms)::hugeint as p
  from cell join v using (lang)),
q as (
  select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * n_terms)::hugeint as q
  from whole join v using (lang)),
pair as (
  select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
term as (
  select lang, source, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value
  from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' as part, item, value,
       (row_number() over (partition by lang, source order by value desc, item))::integer as rank
from pair
union all
select * from (
  select lang, source, 'term' as part, item, value,
         (row_number() over (partition by lang, source order by value desc, item))::integer as rank
  from term) where rank <= 10
"""


@query("op11_source_divergence", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


@query("op13_importance_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


#: The contract's rules (fixed values).
URL_RULES = [("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK)]


@query("op12_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
