"""Secret scans: patterns for whole secrets, and linking of parts that are weak alone.

Base kinds are reported wherever they stand:
    assign  a credential word, ``:`` or ``=``, and a value of 8 or more characters
    access  an access key id
    hex     a run of 32 or more lower-case hex digits
Weak kinds are only parts of a credential, each common in harmless text:
    id        a token of capitals and digits, 12 or more, with 2 or more of each
    secret    a token of 20 or more with a capital, a small letter and a digit
    endpoint  a URL, or an IPv4 address with or without a port; a URL's user
              information, query and fragment are no part of it, so that parts
              in them stand for themselves
A weak part is reported only if a complementary part lies in its scope, that is
in the same document with at most ``scope`` code points between the two: an id
needs a secret, a secret needs an id or an endpoint, an endpoint needs a
secret.  Base spans count as parts too (access as id, assign and hex as secret).
Parts of different kinds may overlap (an id in a longer token, a token in a
URL's path): each counts for others, but they don't complement each other.

The scan makes one row per document; the linking is an interval join between
parts, on the document and on bins ``scope`` wide, so that only neighbours meet.
Parts of one kind don't overlap, so a bin never holds many.

Defined cases: null text is empty and has no spans; a row is scanned as often
as it occurs; a null id is kept; extra columns are ignored; an empty table
gives no rows.  Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: What a kind needs near it.
NEEDS = {"id": ("assign", "hex", "secret"), "secret": ("access", "id", "endpoint"), "endpoint": ("assign", "hex", "secret")}
SCOPE = 200

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{12,}(?![A-Za-z0-9])")
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"https?://(?:(?:[^\s\"'<>/?#@]*@)(?P<host>[^\s\"'<>?#]+)|[^\s\"'<>?#]+)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?(?![\d.])")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind (a place in KINDS), start, end


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak parts that overlap no base span; those of one kind don't overlap."""
    digit = DIGIT.search(text)
    if not digit and "://" not in text:
        return []
    found = [(5, *m.span("host" if m["host"] else 0)) for m in ENDPOINT.finditer(text)]
    for m in WEAK_ID.finditer(text) if digit else ():
        digits = sum(c.isdigit() for c in m[0])
        if 2 <= digits <= len(m[0]) - 2:
            found.append((3, *m.span()))
    for m in WEAK_SECRET.finditer(text) if digit else ():
        if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and DIGIT.search(m[0]):
            found.append((4, *m.span()))
    ends, starts = [0], [0]  # the base spans, joined where they overlap
    for s, e in sorted((s, e) for _, s, e in base):
        if s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return [(kind, s, e) for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])) if ends[bisect.bisect_left(starts, e) - 1] <= s]


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """task and nth (which name the row), doc_id, base and weak (arrays of kind, start, end)."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            base, weak = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text or "")
                base.append([{"start": s, "kind": k, "end": e} for k, s, e in own])
                weak.append([{"start": s, "kind": k, "end": e} for k, s, e in weak_spans(text or "", own)])
            n = len(base)
            yield pa.RecordBatch.from_pydict({"task": pa.array([task] * n, pa.int32()), "nth": pa.array(range(nth, nth + n), pa.int64()), "doc_id": batch.column(0), "base": pa.array(base, spans), "weak": pa.array(weak, spans)})
            nth += n

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "array<struct<start:long,kind:int,end:long>>"
    return src.mapInArrow(run, f"task int, nth long, doc_id long, base {kind}, weak {kind}")


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row that has any: task, nth, linked (its weak parts with a complementary part in scope)."""
    key = ["task", "nth"]
    weak = rows.select(*key, F.explode("weak").alias("p")).select(*key, "p.*")
    every = rows.filter("size(weak) > 0").select(*key, F.explode(F.concat("base", "weak")).alias("p")).select(*key, "p.*")

    def bins(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(F.greatest(a, F.lit(0)) / scope), F.floor(b / scope)))

    near = weak.withColumn("bin", bins(F.col("start") - scope - 1, F.col("end") + scope))  # a part that ends at start - scope has its last place before
    parts = every.withColumn("bin", bins(F.col("start"), F.col("end") - 1))
    fits = [(F.col("w.kind") == KINDS.index(k)) & F.col("p.kind").isin([KINDS.index(x) for x in needs]) for k, needs in NEEDS.items()]
    on = (fits[0] | fits[1] | fits[2]) & (F.col("w.start") <= F.col("p.end") + scope) & (F.col("p.start") <= F.col("w.end") + scope)
    on = on & ((F.col("p.end") <= F.col("w.start")) | (F.col("p.start") >= F.col("w.end")))
    for c in [*key, "bin"]:
        on = on & (F.col(f"w.{c}") == F.col(f"p.{c}"))
    hits = near.alias("w").join(parts.alias("p"), on, "left_semi").select(*key, F.struct("start", "kind", "end").alias("s"))
    return hits.groupBy(*key).agg(F.collect_set("s").alias("linked"))


def find_secrets(docs: DataFrame, *, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, base and linked, arrays of (start, kind, end) in order."""
    need(docs, id_col, text_col)
    rows = Workspace(docs.sparkSession, "secrets").save(scan(docs, id_col, text_col), "scan")
    out = rows.join(link(rows, scope), ["task", "nth"], "left")
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.coalesce("linked", none)).alias("linked"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas, by start and then by kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(said, ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
