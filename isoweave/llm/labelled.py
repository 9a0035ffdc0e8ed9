"""A bounded sample of labelled documents, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import need


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, id_col: str = "doc_id", text_col: str = "text", keep=None) -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label) of at most ``per_class`` documents of label 0 and of label 1, and both labels' counts.

    Among rows that ``keep`` (a condition on the id column) leaves; rows with a
    null id or label are left out, and an id labelled twice counts once, with
    the smaller label.  Of several texts with one id the least one stands for all.
    """
    need(docs, id_col, text_col)
    need(labels, id_col, label)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    if keep is not None:
        known = known.filter(keep)
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    counts = {int(r.label): int(r.n) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("id"), F.col("id")]
    ids = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    own = texts.join(F.broadcast(ids), "id")  # 2 * per_class ids at most
    return own.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label"), counts  # and one text of each
