"""The stages of the pipeline on planted cases, each on its own input."""

import random

import corpus_pipeline as cp
from isoweave.llm import queries
from tests.llm.test_operators import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_catch_planted_cases(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 45)
    shared = prose(rng, 60)
    rows, toxic = [], []
    for i in range(200):
        text = "\n".join(prose(rng, 20) for _ in range(4))
        if i % 5 == 0:
            text += " idiot scum idiot moron"
            toxic.append(i)
        rows.append((i, text, "en", "s", len(text)))
    add = lambda i, t: rows.append((i, t, "en", "s", len(t or "")))
    add(300, rows[1][1]), add(301, rows[1][1] + " end"), add(302, shared + "\n" + prose(rng, 30)), add(303, prose(rng, 30) + "\n" + shared)
    add(304, prose(rng, 40) + " " + item + " " + prose(rng, 40)), add(305, None), add(306, "")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    every = ids(docs)

    stage = dict(cp.STAGES)
    one = stage["toxicity"](spark, docs, sf)
    assert one.columns == docs.columns and ids(one) == every - set(toxic)
    two = stage["line_dedup"](spark, docs, sf)
    text = {r.doc_id: r.text for r in two.collect()}
    assert two.columns == docs.columns and ids(two) == every
    assert text[300] == "" and shared in text[302] and shared not in text[303] and text[2] == rows[2][1]
    three = stage["jaccard_join"](spark, docs, sf)
    assert three.columns == docs.columns and ids(three) == every - {300, 301}
    four = stage["decontamination"](spark, docs, sf)
    assert four.columns == docs.columns and ids(four) == every - {304}
    assert ids(stage["packing"](spark, docs, sf)) == every
    assert ids(cp.run(spark, sf)) == every - set(toxic) - {304}  # 301 keeps the one line of its own


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    rows = [(i, f"plain words number {i} of a text", -1.0, "mine", 7) for i in range(8)] + [(8, None, -1.0, "mine", 7), (None, "no id", -1.0, "mine", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Severity double, rejected string, n_lines int")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (cp.toxicity, cp.line_dedup, cp.jaccard_join, cp.decontamination):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) == len(rows) and all((r.Severity, r.rejected, r.n_lines) == (-1.0, "mine", 7) for r in got)


def test_stages_bound_the_rows_of_a_batch(spark, tmp_path):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    n = 2 * cp.BATCH + 500
    texts = spark.range(0, n, 1, 1).selectExpr("id doc_id", "concat('words of text ', id) text")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "a benchmark item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = lambda df: [r.n for r in df.coalesce(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    try:
        for stage in (cp.toxicity, cp.decontamination):
            spark.conf.set(key, before)
            got = sizes(stage(spark, docs, str(tmp_path)))
            assert sum(got) == n and max(got) <= cp.BATCH
        spark.conf.set(key, "7")
        cp.decontamination(spark, docs, str(tmp_path))
        assert spark.conf.get(key) == "7"
        spark.conf.set(key, before)
        assert cp.run(spark, str(tmp_path)).count() == n
        assert spark.conf.get(key) == before
    finally:
        spark.conf.set(key, before)
