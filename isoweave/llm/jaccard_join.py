"""N-gram Jaccard join: texts whose shingle sets have a Jaccard index of at least a threshold.

A text's set holds its distinct ``width``-word shingles as 64-bit hashes; texts
of one set are one class, named by a hash of the set, and join once.  A set of n
tokens may lose n - ceil(t n) of them to a partner and still link.

1. Which classes can link at all.  The first tokens of each set in hash order,
   0.4 times as many again as it may lose, are counted over all classes.  Of two
   that link, the one whose prefix ends first has all it shares there in the
   other's prefix too; so both hold a known number of tokens that another class
   holds there.  Classes with fewer can't link.  Only the rest, the candidates,
   are kept as whole sets, read again from their texts.
2. The index.  Tokens, of which it keeps 40 bits (two of a set that are equal
   there count as two), are counted over the candidates; those of one class drop
   out and count as lost.  The others are ordered by count, rarest first, and
   fall into frequency classes: up to ``FREQUENT`` classes a token stands alone
   in the index, above that only combinations of two frequent tokens do, above
   ``VERY_FREQUENT`` of three.  Frequent tokens combine only within groups (by
   their hash), more groups for larger sets, so that combinations grow as the
   prefix.  A prefix is extended until, with all losses a set may have, some
   group still keeps a whole combination: sum of (tokens of a group - size of its
   combinations + 1) > losses.  The pair's smaller set names the number of
   groups; the larger one is indexed for all sizes that a partner may have.
3. Rounds of merging.  Within each key, in an order by hash, neighbours of
   different components whose sizes and signatures fit are compared, the
   likeliest pair of each class only, and linked classes are joined, while a round
   finds at least a quarter of the links of the one before.  This finds no link
   that step 4 would miss; it spares it the pairs within components.
4. The rest.  Under each key, members outside the key's largest component meet
   all members of other components, in cells of ``CELL`` by ``CELL`` rows, so that
   no key is one task, and only where their sizes are near.  A pair that shares several keys is taken up under the least
   of those that are among the first ``FEW`` of both, or under all if there is none.
   What fits is verified on the whole sets.

Pairs fit if their sizes allow the threshold and so do their signatures: sets
differ in at least as many tokens as their 512-bit parity signatures in bits.

Defined cases: null or empty texts have no shingles and link with nothing; rows
with a null id are left alone; rows with one id are texts of one document, and
what one of them links to the others reach too; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need
from isoweave.llm.components import components
from isoweave.llm.shingle_sets import mix, shingle_set

#: Candidate classes up to which a token is rare; beyond the second number, combinations of three.
FREQUENT, VERY_FREQUENT = 32, 2048
#: Rows of a key that meet in one task; rounds of merging before the rest; ids that may be broadcast (8 MB).
CELL, ROUNDS, BROADCAST_IDS = 2048, 4, 1 << 20
#: First keys of a class that tell under which of them a pair is taken up.
FEW = 16
#: Bits of a token in the index, which has its count above them, up to ``MOST``.
BITS = 40
SHORT, MOST = (1 << BITS) - 1, (1 << 63 - BITS) - 1
#: Rows of whole sets that a Python worker holds at once.
SET_ROWS = 1000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SIGN = [f"s{k}" for k in range(8)]


def least_shared(n: int, percent: int) -> int:
    """How many tokens of a set of ``n`` any partner must hold."""
    return (percent * n + 99) // 100


def first_length(n: int, percent: int) -> int:
    """Length of the prefix, in hash order, that step 1 counts."""
    lost = n - least_shared(n, percent)
    return min(n, lost + (2 * lost + 4) // 5 + 4)


def groups_of(n: int, percent: int) -> int:
    """Groups of frequent tokens for pairs whose smaller set has ``n``, a power of 2; 0 if all tokens stand alone.

    At most (least_shared - 1) / 3, so that a whole set always suffices as its own prefix.
    """
    keep = least_shared(n, percent)
    return 1 << (max(1, min((n - keep) // 4, (keep - 1) // 3)).bit_length() - 1) if keep > 3 else 0


def _name(s: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh3_64_digest(s.tobytes()), ">i8")[0])


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def _scan(source: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: id, sid (the class; null without shingles or id), n, low (its first tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, low = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text or b"", width)
                fine = len(s) and i is not None
                sizes.append(len(s))
                sids.append(_name(s) if fine else None)
                low.append(s[: first_length(len(s), percent)].view(np.int64) if fine else None)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "sid": pa.array(sids, pa.int64()), "n": pa.array(sizes, pa.int64()), "low": pa.array(low, pa.list_(pa.int64()))})

    return source.mapInArrow(run, "id long, sid long, n long, low array<long>")


def _candidates(classes: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(sid, n, id) of the classes that may link: enough of their first tokens are another's first tokens."""
    tokens = classes.select("sid", F.explode("low").alias("token"))
    shared = work.save(tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared")
    held = tokens.join(shared, "token").groupBy("sid").agg(F.count("*").alias("s"))
    least = F.floor((percent * F.col("n") + 99) / 100)  # the smallest partner
    keep = F.floor((percent * least + 99) / 100)
    enough = F.least(keep, F.floor((2 * (least - keep) + 4) / 5) + 4)
    found = held.join(classes.select("sid", "n", F.col("least").alias("id")), "sid").filter(F.col("s") >= enough)
    out = work.save(found.select("sid", "n", "id"), "candidates")
    work.drop("shared")
    return out


def _signature(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & 511, minlength=512) & 1).view("<i8")


def _whole_sets(source: DataFrame, wanted: DataFrame, width: int, work: Workspace) -> DataFrame:
    """(sid, n, tokens, s0 to s7) of the wanted (sid, id); other texts are passed over."""
    few = wanted.count() <= BROADCAST_IDS
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for text in batch.column("text").to_pylist() if len(s := shingle_set(text or b"", width))]
            signs = np.stack([_signature(s) for s in sets]) if sets else np.zeros((0, 8), np.int64)
            cols = {"sid": pa.array([_name(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(cols | {c: pa.array(np.ascontiguousarray(signs[:, k])) for k, c in enumerate(_SIGN)})

    signs = ", ".join(f"{c} long" for c in _SIGN)
    texts = source.join(small(wanted.select("id").distinct()), "id", "left_semi").select("text")
    found = texts.mapInArrow(run, f"sid long, n long, tokens array<long>, {signs}")
    once = found.join(small(wanted.select("sid")), "sid", "left_semi").groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "tokens", *_SIGN)])
    return work.save(once, "sets")


def _combinations(tokens: np.ndarray, size: np.ndarray, groups: int, losses: int) -> np.ndarray:
    """Keys of the extended prefix of ordered tokens that combine by ``size``, for pairs with so many groups."""
    size = size if groups else np.ones_like(size)
    g = max(groups, 1)
    group = np.where(size == 1, 0, size * g + (tokens >> np.uint64(20)).astype(np.int64) % g)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    nth = np.empty(len(tokens), np.int64)  # place of a token in its group
    nth[order] = np.arange(len(tokens)) - np.repeat(starts, np.diff(starts, append=len(tokens)))
    kept = np.cumsum(nth + 1 >= size)
    p = int(np.searchsorted(kept, losses + 1)) + 1
    tokens, size, group = tokens[:p], size[:p], group[:p]
    salt = np.uint64(groups + 1)
    keys = [mix(tokens[size == 1] * _MULT + salt)]
    members: dict[int, list[int]] = {}
    for k in np.flatnonzero(size > 1).tolist():
        members.setdefault(int(group[k]), []).append(k)
    for k in (2, 3):
        at = np.array([c for own in members.values() if size[own[0]] == k for c in itertools.combinations(own, k)], np.int64).reshape(-1, k)
        h = np.full(len(at), salt)
        for j in range(k):
            h = mix(h * _MULT + tokens[at[:, j]])
        keys.append(h)
    return np.unique(np.concatenate(keys))


def _index(sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(key, sid, c): the keys of every candidate's extended prefix that another shares, with their classes."""
    short = F.col("token").bitwiseAND(F.lit(SHORT))  # tokens that meet in these bits only make a pair likelier to be verified
    tokens = sets.select("sid", "n", F.explode("tokens").alias("token")).select("sid", "n", short.alias("token"))
    often = work.save(tokens.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "often")
    counted = F.shiftleft(F.least("c", F.lit(MOST)), BITS).bitwiseOR(F.col("token"))
    core = tokens.join(often, "token").groupBy("sid", "n").agg(F.collect_list(counted).alias("core"))  # a set's tokens at most
    rare, very = FREQUENT, VERY_FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core, sids, keys = batch.column("core"), [], []
            for k, (sid, n) in enumerate(zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(), strict=True)):
                keep = least_shared(n, percent)
                own = np.sort(core[k].values.to_numpy())
                if len(own) < keep:
                    continue
                c, t = own >> BITS, (own & SHORT).view(np.uint64)
                size = 1 + (c > rare).astype(np.int64) + (c > very)
                for g in _groups_between(keep, n, percent):
                    own_keys = _combinations(t, size, g, len(t) - keep)
                    keys.append(own_keys.view(np.int64))
                    sids.append(np.full(len(own_keys), sid, np.int64))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "sid": pa.array(np.concatenate(sids))})

    index = work.save(core.mapInArrow(run, "key long, sid long"), "index")
    many = index.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    out = work.save(index.join(many, "key"), "lists")
    work.drop("often", "index")
    return out


def _groups_between(low: int, high: int, percent: int) -> list[int]:
    """The numbers of groups for sizes from ``low`` to ``high``; they only grow with the size."""
    a, b = groups_of(low, percent), groups_of(high, percent)
    return [0] * (not a) + [g for k in range(b.bit_length()) if (g := 1 << k) >= max(a, 1)]


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether two rows' sizes and signatures allow the threshold."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    # at the threshold |x - y| + |y - x| = (n1 + n2) (1 - t) / (1 + t)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (_differ(a, b) * (100 + percent) <= (n1 + n2) * (100 - percent))


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SIGN), F.lit(0))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold, by their whole sets."""
    one = sets.select("sid", "tokens")
    if 2 * pairs.count() <= BROADCAST_IDS:  # only the sets of these pairs are dealt out
        one = one.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("sid"))), "sid", "left_semi")
    both = pairs.select("a", "b").join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, good = batch.column("x"), batch.column("y"), []
            for k in range(batch.num_rows):
                x, y = (np.asarray(c[k].values.to_numpy()).view(np.uint64) for c in (xs, ys))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return work.save(both.mapInArrow(exact, "a long, b long"), name)


def _with_components(lists: DataFrame, nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(key, c, r): the index with r, a row's class, size, signature and component."""
    known = nodes.withColumn("component", F.col("sid"))
    if groups is not None:
        known = nodes.join(groups.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    return lists.join(known, "sid").select("key", "c", F.struct("sid", "n", "component", *_SIGN).alias("r"))


def _neighbours(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): for each class the likeliest of the classes beside it under its keys, in the order of a hash."""
    beside = rows.withColumn("l", F.expr(f"lag(r) over (partition by key, pmod(xxhash64(r.sid, {-1 - turn}), ceil(c / {CELL})) order by xxhash64(r.sid, {turn}))"))
    beside = beside.filter("l is not null and l.component <> r.component").filter(_fits("l", "r", percent))
    pairs = beside.select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b"), _differ("l", "r").alias("d")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(rows: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """(a, b): every fitting pair of classes of different components that share a key, in cells of bounded size."""
    rows = work.save(rows, "indexed")
    each = rows.groupBy("key", F.col("r.component").alias("component")).agg(F.count("*").alias("m"))
    sums = each.groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    sums = sums.select("key", F.ceil(F.col("m") / CELL).alias("wide"), F.ceil((F.col("m") - F.col("top.m")) / CELL).alias("high"), F.col("top.component").alias("top"))
    known = rows.join(sums, "key")
    few = known.groupBy(F.col("r.sid").alias("sid")).agg(F.slice(F.array_sort(F.collect_list("key")), 1, FEW).alias("few"))  # a set's keys at most
    known = work.save(known.withColumn("sid", F.col("r.sid")).join(few, "sid").drop("sid"), "across")
    work.drop("indexed")
    row, col = F.pmod(F.xxhash64("r.sid"), F.col("high")), F.pmod(F.xxhash64("r.sid"), F.col("wide"))
    x = known.filter("r.component <> top").select("key", row.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide").cast("int") - 1)).alias("j"), F.col("r").alias("x"), F.col("few").alias("fx"), F.col("top").alias("t"))
    y = known.select("key", F.explode(F.sequence(F.lit(0), F.col("high").cast("int") - 1)).alias("i"), col.alias("j"), F.col("r").alias("y"), F.col("few").alias("fy"))
    # sizes of a pair are at most one step of the threshold's ratio apart
    size = lambda r: F.floor(F.log(F.col(f"{r}.n").cast("double")) / (1.0001 * math.log(100 / percent))).cast("int") if percent < 100 else F.col(f"{r}.n")
    x = x.withColumn("i", F.col("i").cast("int")).withColumn("size", F.explode(F.array(*[size("x") + d for d in (-1, 0, 1)])))
    y = y.withColumn("j", F.col("j").cast("int")).withColumn("size", size("y"))
    # two members outside the largest component meet twice; they count once
    once = (F.col("y.component") == F.col("t")) | (F.col("x.sid") < F.col("y.sid"))
    # and a pair under the least key that both have among their first ones, if there is any
    here = F.coalesce(F.array_min(F.array_intersect("fx", "fy")), F.col("key")) == F.col("key")
    on = (F.col("x.component") != F.col("y.component")) & once & _fits("x", "y", percent) & here
    met = x.join(y, ["key", "i", "j", "size"]).filter(on).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, sid, n) of all rows, (sid, least) of all classes, and the whole sets of those that may link."""
    need(docs, id_col, text_col)
    source = _source(docs, id_col, text_col)
    rows = work.save(_scan(source, width, percent), "rows")
    slim = work.save(rows.select("id", "sid", "n"), "slim")
    grouped = rows.filter("sid is not null").groupBy("sid").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("low").alias("low"))
    classes = work.save(grouped, "classes")
    work.drop("rows")
    wanted = _candidates(classes, percent, work)
    least = work.save(classes.select("sid", "least"), "least")
    work.drop("classes")
    sets = _whole_sets(source, wanted, width, work)
    work.drop("candidates")
    return slim, least, sets


def jaccard_links(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: every pair of classes that link, each named by its least id; copies are not expanded."""
    work = Workspace(docs.sparkSession, "jaccard_links", SET_ROWS)
    _, least, sets = _classes(docs, width, percent, id_col, text_col, work)
    rows = _with_components(_index(sets, percent, work), sets.select("sid", "n", *_SIGN), None)
    found = _verified(work.save(_across(rows, percent, work), "pairs"), sets, percent, work, "links")
    named = found.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the least id reached by links, its own included)."""
    work = Workspace(docs.sparkSession, "jaccard_join", SET_ROWS)
    slim, least, sets = _classes(docs, width, percent, id_col, text_col, work)
    nodes = work.save(sets.select("sid", "n", *_SIGN), "nodes")
    lists = _index(sets, percent, work)

    groups, before = None, 0
    for turn in range(ROUNDS):
        pairs = work.save(_neighbours(_with_components(lists, nodes, groups), percent, turn), f"pairs-{turn}")
        found = _verified(pairs, sets, percent, work, f"links-{turn}")
        work.drop(f"pairs-{turn}")
        many = found.count()
        if 4 * many <= before or not many:  # the rounds are done with what they can merge; step 4 finds these too
            break
        before = many
        if groups is not None:
            found = found.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b")))
        groups = work.save(components(found, work, f"cc-{turn}"), f"groups-{turn}")
        work.drop(f"links-{turn}", *([f"groups-{turn - 1}"] if turn else []))
    pairs = work.save(_across(_with_components(lists, nodes, groups), percent, work), "rest")
    work.drop("lists", "nodes", "across")
    links = _verified(pairs, sets, percent, work, "links")
    work.drop("sets", "rest")
    if groups is not None:
        links = links.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b")))

    # in ids: classes by their least one, and the classes of one document reach each other
    named = links.join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    with_least = slim.join(least, "sid", "left")
    several = slim.filter("sid is not null").groupBy("id").agg(F.min("sid").alias("p"), F.max("sid").alias("q")).filter("p <> q").select("id")
    tied = with_least.join(several, "id").select(F.col("id").alias("a"), F.col("least").alias("b")).filter("b is not null")
    final = components(named.unionByName(tied), work, "last")
    out = with_least.join(final.toDF("least", "component"), "least", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "least", "id").alias("component_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents of which each group keeps one, that of the least id, with all their columns."""
    id_col = options.get("id_col", "doc_id")
    found = jaccard_components(docs, **options).filter(F.col(id_col) != F.col("component_id"))
    gone = found.select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
