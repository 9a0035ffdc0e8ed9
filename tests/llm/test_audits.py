"""Source divergence, URL filters and importance resampling against plain versions, on every odd case."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

UP = {k: k + 32 for k in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, score double, rank int"


def rows_of(texts, langs=("en", "de"), sources=("a", "b", "é")):
    rng = random.Random(2)
    return [(i, t, rng.choice(langs), rng.choice(sources), 1, "x", 0.5, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [a + b for a in ("Tha", "er", "ön", "sh", "x9") for b in ("an", "st", "", "É")]
    out = [" ".join(rng.choice(words[: rng.randint(3, 20)]) + rng.choice(["", "", ",", "1"]) for _ in range(rng.randint(1, 60))) for _ in range(70)]
    return [*out, out[0], out[0], None, "", " ", "\x00\x7f", "12 34", "w" * 300 + " " + "ü" * 90, "a" * 70 + " b", " ".join(rng.choice(words) for _ in range(4000))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = rows_of(texts) + [(None, texts[1], None, None, None, None, None, None), (5, texts[5], "en", "a", 1, "x", 0.5, 3), (500, "", "fr", "only", 1, "x", 0.5, 3), (501, "", "it", "p", 1, "x", 0.5, 3), (502, None, "it", "q", 1, "x", 0.5, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_divergence(rows, min_docs, top):
    found = collections.defaultdict(collections.Counter)
    held = collections.defaultdict(collections.Counter)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r.text or "").translate(UP))
        found[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        sources = [s for x, s in found if x == lang]
        whole = sum((found[lang, s] for s in sources), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        q, ps = share(whole), {s: share(found[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(ps[s][t], q[t])) for t in kept if found[lang, s][t] and ps[s][t] > q[t]]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items[:most])}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(10, 10), (2, 3), (1000, 10)])
def test_source_divergence(docs, empty, min_docs, top):
    from isoweave.llm.source_audit import source_divergence

    got = source_divergence(docs, min_docs=min_docs, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    rows = got.collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == plain_divergence(docs.collect(), min_docs, top)
    assert source_divergence(empty).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    from isoweave.llm.source_audit import _share

    cases = [(0, 1, 1), (8_999_999_998, 10**13, 7), (8_999_999_999, 10**13, 7), (3 * 10**14 + 1, 10**15 + 11, 10**6), (10**15, 10**15, 1)]
    df = spark.createDataFrame(cases, "n long, total long, n_terms long")
    got = [r[0] for r in df.select(F.expr(_share("n", "total"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in cases]


def plain_features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UP))
    return words, [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_features_are_checksums_of_words_and_pairs(texts, piece, monkeypatch):
    from isoweave.llm import resampling

    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling, "BLOCK", piece * 4)
    for cache in (100_000, 8):
        found, words = collections.defaultdict(collections.Counter), collections.Counter()
        for row, bucket, of_word in resampling.Features(10000, cache).of_texts([None if t is None else t.encode() for t in texts]):
            words.update(of_word.tolist())
            for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
                found[r][b] += 1
        for k, t in enumerate(texts):
            w, f = plain_features(t)
            assert found[k] == collections.Counter(f) and words[k] == len(w)


def test_a_worker_holds_a_block_of_features_whatever_the_vocabulary():
    from isoweave.llm import resampling

    texts = (b" ".join(b"w%d" % k for k in range(n, n + 3000)) for n in range(0, 900_000, 3000))
    long = b" ".join(b"w%d" % k for k in range(300_000))
    n_words, n_features, found = 0, 0, resampling.Features()
    tracemalloc.start()
    try:
        for text in (texts, [long]):
            for row, _, of_word in found.of_texts(text if isinstance(text, list) else list(text)):
                n_words, n_features = n_words + len(of_word), n_features + len(row)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n_words == 1_200_000 and n_features == 2 * n_words - 301
    assert peak < 40e6  # the texts themselves: 7 MB


def test_batches_are_small_and_settings_come_back(spark):
    from isoweave.llm import common, resampling

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = spark.range(0, 3000, 1, 1)
    with common.held(spark, common.arrow_rows(resampling.BATCH)):
        most = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert most <= resampling.BATCH and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), common.held(spark, {key: "7", "spark.isoweave.none": "1"}):
        1 / 0  # noqa: B018
    assert spark.conf.get(key) == before and spark.conf.get("spark.isoweave.none", None) is None


@pytest.mark.parametrize(("percent", "least"), [(25, 20), (100, 0), (1, 20), (60, 1)])
def test_resampling(spark, docs, empty, percent, least):
    from isoweave.llm.resampling import resample

    target = spark.createDataFrame([("Than shst Ér",), (None,), ("x9É er er",)], "text string")
    got = resample(docs, target, percent=percent, least_words=least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = [(r.doc_id, *plain_features(r.text)) for r in docs.collect()]
    s = collections.Counter(x for *_, f in rows for x in f)
    t = collections.Counter(x for r in target.collect() for x in plain_features(r.text)[1])
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + 10000) / ((s[k] + 1) * (t.total() + 10000))))
    want = []
    for i, words, f in rows:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in want if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    many = len(able) * percent // 100
    full = [(*r, k + 1 if k < many else None) for k, r in enumerate(able)] + [(*r, None) for r in want if r[1] < least]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(full)
    assert resample(empty, target).count() == 0 and resample(docs, empty).count() == len(rows)


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(UP)
    fits = [(len(r), r, v) for r, v in RULES for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    from isoweave.llm.url_filter import filter_urls

    urls = ["http://a.com/x", "HTTP://WWW.Example.COM/en/1", "http://m.example.com/en/", "http://example.com/en", "http://example.com/EN/1", "http://xexample.com/en/1", "https://b.net/es/9?x=/fr/", "http://net/fr/1", "http://b.net/de/1", "http://a.com", "http://a.com?q", "http://c.org/en/://d.com/x", "a.com/x", "", None, "://", "x\n://a.com/\n/b?c\n#d", "http://ünï.com/é", "http://a.com:80/x", "http://com/", "http://.com/", "//x", "http://b.net/es/" + "y" * 100_000]
    df = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate([*urls, urls[0]])], "page_id long, url string, host string, path string, label string")
    got = {r.page_id: r for r in filter_urls(df, RULES).collect()}
    assert len(got) == len(urls) + 1
    for k, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == verdict if rule else got[k].verdict in ("allow", "block")
    assert filter_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in filter_urls(df.filter("page_id = 13 or url is null or page_id = 8"), RULES).collect()} == {"allow"}


def test_url_model_on_urls_it_has_not_seen(spark):
    from isoweave.llm.common import Workspace
    from isoweave.llm.url_filter import fit_urls, host_of, path_of

    rng = random.Random(4)
    name = lambda n, pool="abcdefghijklmnop": "".join(rng.choice(pool) for _ in range(n))
    rows = []
    for k in range(3000):
        bad = k % 3 == 0
        host = f"{name(5)}.{rng.choice(['com', 'org'])}" if rng.random() < 0.9 else f"{name(4)}.{'xyz' if bad else 'edu'}"
        path = "/" + (name(24, "0123456789abc") + "/" + name(9) + f"?a={name(3)}&b={name(3)}&c=1" if bad else name(7) + rng.choice(["", "/" + name(5)]))
        rows.append((k, f"https://{host}{path}", int(bad)))
    df = spark.createDataFrame(rows, "id long, url string, label int").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    for per_label in (20_000, 300):
        model = fit_urls(df.filter("id % 4 > 0"), Workspace(spark, "test"), per_label=per_label)
        held = model.score(df.filter("id % 4 = 0").drop("id")).collect()
        assert np.mean([(r.p_block > 0.5) == (r.label == 1) for r in held]) > 0.97


def test_statistics_leave_a_url_out_of_its_own(spark):
    from isoweave.llm.url_filter import part_statistics, with_statistics

    rows = [("a", k % 5, int(k < 7)) for k in range(20)] + [("rare", 0, 1)]
    df = spark.createDataFrame(rows, "part string, fold int, label int")
    known = part_statistics(df, "part")
    assert [(r.part, r.n, r.blocked) for r in known.collect()] == [("a", 20, 7)]
    for r in with_statistics(df, {"part": known}, 0.5, out_of_fold=True).collect():
        rest = [x[2] for x in rows if x[0] == r.part == "a" and x[1] != r.fold]
        assert r.part_blocked == pytest.approx((sum(rest) + 5) / (len(rest) + 10)) and r.part_seen == pytest.approx(math.log1p(len(rest)))
