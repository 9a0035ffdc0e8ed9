"""Translated search, the plan of spliced searches, and the stages, on planted genomes and against plain loops."""

import collections
import random

import pytest

from isoweave.functions import bio
from isoweave.operators import intervals, search
from isoweave.sources.text import chunked

BACK = {}
for k, amino in enumerate(bio.CODONS):
    BACK.setdefault(amino, "ACGT"[k // 16] + "ACGT"[k // 4 % 4] + "ACGT"[k % 4])
FLIP = str.maketrans("ACGT", "TGCA")


def bases(rng, n):
    return "".join(rng.choice("ACT") for _ in range(n))


def residues(rng, n):
    return "".join(rng.choice(bio.AMINO) for _ in range(n))


def coded(text):
    return "".join(BACK[a] for a in text)


@pytest.mark.parametrize("size", [64, 100, 100_000])
def test_planted_exons_are_found_once_on_both_strands_and_across_borders(spark, size):
    rng = random.Random(size)
    exons = {k: residues(rng, rng.randint(16, 60)) for k in range(12)}
    proteins, genome, want = [], {}, set()
    for k, e in exons.items():
        lead = residues(rng, rng.randint(0, 30))
        proteins.append((k, lead + e + residues(rng, rng.randint(0, 30))))
        chrom, strand = f"chr{k % 3}", 1 if k % 2 else -1
        gap = bases(rng, rng.randint(50, 90))
        dna = genome.get(chrom, "") + gap
        body = coded(e) if strand > 0 else coded(e)[::-1].translate(FLIP)
        first, last = len(dna) + 1, len(dna) + len(body)
        genome[chrom] = dna + body
        want.add((k, chrom, strand, len(lead), len(lead) + len(e) - 1, *((first, last) if strand > 0 else (last, first))))
    genome = {c: s + bases(rng, 70) for c, s in genome.items()}
    worn = list(proteins[0][1])
    at = next(iter(r for r in want if r[0] == 0))[3] + 8
    worn[at] = "W" if worn[at] != "W" else "Y"
    proteins += [(100, ""), (101, "W" * 40), (102, "ABZ*"), (103, "".join(worn)), (None, proteins[1][1])]
    seqs = spark.createDataFrame(proteins, "seq_id long, residues string")
    chunks = chunked(spark.createDataFrame([*genome.items(), ("tiny", "ACGT"), ("none", "")], "chr string, sequence string"), size)
    sizes = spark.createDataFrame([(c, len(s)) for c, s in genome.items()] + [("tiny", 4)], "chr string, size long")
    hits = search.translated_search(seqs, chunks, sizes, size).collect()
    found = collections.Counter((r.seq_id, r.chr, r.strand) for r in hits)
    assert set(found.values()) == {1} and {k for k, *_ in found} == {*exons, 103}
    got = {(r.seq_id, r.chr, r.strand): r for r in hits}
    for k, chrom, strand, a0, a1, n0, n1 in want:
        r = got[k, chrom, strand]
        # a chance match beside the exon may lengthen the hit by a residue or two
        assert r.a_start <= a0 and r.a_end >= a1 and r.a_end - r.a_start <= a1 - a0 + 6
        assert r.n_start - n0 == 3 * strand * (r.a_start - a0) and r.n_end - n1 == 3 * strand * (r.a_end - a1)
    worn_hit = next(r for r in hits if r.seq_id == 103)
    assert worn_hit.score < got[0, worn_hit.chr, worn_hit.strand].score and worn_hit.pct < 100
    assert search.translated_search(seqs.limit(0), chunks, sizes, size).count() == 0


def test_repeats_seed_nothing_but_are_read_through(spark):
    rng = random.Random(3)
    repeat, own = residues(rng, 14), residues(rng, 20)
    dna = "".join(bases(rng, 30) + coded(repeat) for _ in range(40)) + bases(rng, 31) + coded(own + repeat) + bases(rng, 30)
    seqs = spark.createDataFrame([(1, own + repeat), (2, repeat)], "seq_id long, residues string")
    chunks, sizes = chunked(spark.createDataFrame([("c", dna)], "chr string, sequence string"), 256), spark.createDataFrame([("c", len(dna))], "chr string, size long")
    hits = search.translated_search(seqs, chunks, sizes, 256, repeats=6).collect()
    assert [(r.seq_id, r.a_start, r.a_end) for r in hits if r.strand > 0 and r.a_end - r.a_start > 25] == [(1, 0, 33)]
    every = search.translated_search(seqs, chunks, sizes, 256, repeats=1000).collect()
    assert sum(r.seq_id == 2 for r in every) >= 40 > sum(r.seq_id == 2 for r in hits)


def test_best_before_stop_equals_the_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for key in range(300):
        values = [rng.choice([None, 0.0, 75.0, 90.5, 91.0, 95.0]) for _ in range(rng.randint(1, 7))]
        rows += [(key, k, v) for k, v in enumerate(values)]
        top, kept = 0.0, None
        for k, v in enumerate(values):
            if (v or 0) > top:
                top, kept = v, k
            elif top:
                break
        if kept is not None:
            want[key] = (kept, top)
    got = search.best_before_stop(spark.createDataFrame(rows, "key long, nth int, pct double"), ["key"], ["nth"], "pct").collect()
    assert {r.key: (r.nth, r.pct) for r in got} == want and len(got) == len(want)


def plain_clusters(ranges, span):
    lo, hi = min(a for a, _ in ranges), max(b for _, b in ranges)
    left = [r for r in ranges if sum(r) < lo + hi]
    right = [r for r in ranges if sum(r) >= lo + hi]
    if hi - lo < span or not left or not right:
        return [(lo, hi)]
    return plain_clusters(left, span) + plain_clusters(right, span)


def plain_padded(ranges, size):
    lo, hi = min(a for a, _ in ranges), max(b for _, b in ranges)
    wide = sorted((max(1, a - search.INNER_PAD - (search.OUTER_PAD if a == lo else 0)), min(size, b + search.INNER_PAD + (search.OUTER_PAD if b == hi else 0))) for a, b in ranges)
    out = []
    for a, b in wide:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def plain_plan(hits, length, sizes, stage, most):
    groups = []
    for chrom, strand in sorted({h[:2] for h in hits}):
        for h in sorted((h for h in hits if h[:2] == (chrom, strand)), key=lambda h: h[2:4]):
            if groups and groups[-1][0] == (chrom, strand) and h[2] <= groups[-1][2] + 25:
                groups[-1][2] = max(groups[-1][2], h[3])
                groups[-1][3].append((min(h[4:6]), max(h[4:6])))
            else:
                groups.append([(chrom, strand), h[2], h[3], [(min(h[4:6]), max(h[4:6]))]])
    turned = lambda found, strand: [(a, b) if strand > 0 else (b, a) for a, b in (found if strand > 0 else sorted(found, key=lambda x: -x[1]))]
    if stage == 3:
        out = []
        for (chrom, strand), a, *_, own in sorted(groups, key=lambda g: (g[1], g[0][0], -g[0][1])):
            out += [(chrom, *x) for x in turned(plain_padded(plain_clusters(own, search.SPAN), sizes[chrom]), strand)]
        return [out] if sum(abs(a - b) for _, a, b in out) <= most else []
    covered = collections.Counter()
    for on, a, b, _ in groups:
        covered[on] += b - a + 1
    order = sorted(covered, key=lambda on: (-covered[on], on[0], -on[1]))
    fifth = covered[order[min(4, len(order) - 1)]]
    plans = []
    for on in order:
        if covered[on] < fifth or 4 * covered[on] < 3 * length:
            continue
        ranges = [c for g in groups if g[0] == on for c in plain_clusters(g[3], search.SPAN)]
        ranges = plain_clusters(ranges, search.SPAN) if stage == 1 else ranges
        padded = plain_padded(ranges, sizes[on[0]])
        plans.append([(on[0], *x) for x in turned(padded, on[1])] if sum(b - a for a, b in padded) <= most else None)
    return plans


@pytest.mark.parametrize("stage", [1, 2, 3])
def test_planned_ranges_equal_a_plain_recursion(spark, stage):
    rng = random.Random(stage)
    sizes = {f"c{k}": 3_000_000 + 500_000 * k for k in range(5)}
    rows, seqs = [], []
    for seq in range(25):
        length = rng.randint(50, 400)
        seqs.append((seq, "A" * length))
        for _ in range(rng.randint(1, 25)):
            chrom, strand = rng.choice(sorted(sizes)[: rng.randint(1, 5)]), rng.choice([1, -1])
            a0 = rng.randrange(length)
            a1 = rng.randrange(a0, length)
            n0 = rng.randint(1, sizes[chrom] - 3 * length)
            n1 = n0 + 3 * (a1 - a0) + 2
            rows.append((seq, chrom, strand, a0, a1, *((n0, n1) if strand > 0 else (n1, n0)), 3 * (a1 - a0)))
    hits = spark.createDataFrame(rows, "seq_id long, chr string, strand int, a_start int, a_end int, n_start long, n_end long, score int")
    size_df = spark.createDataFrame(list(sizes.items()), "chr string, size long")
    seq_df = spark.createDataFrame(seqs, "seq_id long, residues string")
    most = 4_000_000
    got = collections.defaultdict(list)
    for r in search.planned_ranges(hits, seq_df, size_df, stage, most).orderBy("seq_id", "search", "part").collect():
        got[r.seq_id, r.search].append((r.chr, r.a, r.b))
    want = {}
    for seq, text in seqs:
        plans = plain_plan([r[1:] for r in rows if r[0] == seq], len(text), sizes, stage, most)
        want |= {(seq, k + 1): p for k, p in enumerate(plans) if p}
    assert dict(got) == want and len(want) > 5


def test_clusters_of_one_place_end():
    assert intervals._sides([(1, 10**7)] * 3, 1000, True) == ["", "", ""]
    assert intervals._sides([(0, 10), (0, 5000), (4000, 5000)], 1000, True) == ["0", "1", "1"]
    assert intervals._sides([(0, 10), (500, 600), (4000, 4100), (9000, 9100)], 1000, False) == ["00", "00", "01", "1"]


def test_stages_find_what_those_before_leave(spark):
    rng = random.Random(8)
    intron = lambda n: "GT" + bases(rng, n) + "AG"
    one = [residues(rng, 40) for _ in range(3)]
    two = [residues(rng, 40) for _ in range(2)]
    c1 = bases(rng, 400) + coded(one[0]) + intron(100) + coded(one[1]) + intron(90) + coded(one[2]) + bases(rng, 300) + coded(two[0]) + intron(50) + bases(rng, 200)
    c2 = bases(rng, 300) + bases(rng, 60) + "AG" + coded(two[1]) + bases(rng, 500)
    genome = {"c1": c1, "c2": c2[::-1].translate(FLIP)}
    chunks = chunked(spark.createDataFrame(list(genome.items()), "chr string, sequence string"), 512)
    sizes = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chr string, size long")
    seqs = spark.createDataFrame([(1, "".join(one)), (2, "".join(two)), (3, residues(rng, 80))], "seq_id long, residues string")
    hits = search.translated_search(seqs, chunks, sizes, 512)
    assert {(r.seq_id, r.chr, r.strand) for r in hits.collect()} == {(1, "c1", 1), (2, "c1", 1), (2, "c2", -1)}
    got = {r.seq_id: r for r in search.staged_search(seqs, hits, chunks, sizes, 512).collect()}
    assert set(got) == {1, 2}
    assert got[1].stage == 1 and got[1].chr == "c1" and len(got[1].exons) == 3 and got[1].pct_id == 100.0
    assert got[2].stage == 3 and got[2].chr == "Chimeric:c1/c2[revcomp]" and got[2].pct_id >= 95
    assert search.staged_search(seqs.filter("seq_id = 3"), hits.filter("seq_id = 3"), chunks, sizes, 512).count() == 0


def test_last_written_map_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, 1, "d")], "seq_id long, phase int, chr string")
    assert {(r.seq_id, r.chr) for r in search.last_written(df, ["seq_id"], "phase").collect()} == {(1, "b"), (2, "d")}


def test_only_tiles_that_a_protein_may_have_leave_the_tasks(spark):
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(20_000))
    chunks = spark.createDataFrame([("c", k, genome[k * 4096 : (k + 1) * 4096]) for k in range(5)], "chr string, chunk long, seq string")
    all_tiles = {tuple(r) for r in search.genome_tiles(chunks, 4096).collect()}
    numbers = sorted(t[0] for t in all_tiles)[::40]
    protein = "".join("".join(search.AMINO[n >> 5 * k & 31] for k in range(search.TILE)) + "X" for n in numbers)
    seqs = spark.createDataFrame([(1, protein), (2, None)], "seq_id int, residues string")
    some = {tuple(r) for r in search.genome_tiles(chunks, 4096, search.tile_filter(seqs)).collect()}
    assert {t for t in all_tiles if t[0] in set(numbers)} <= some <= all_tiles
    assert len(some) < len(all_tiles) / 10
    assert not search.genome_tiles(chunks, 4096, search.tile_filter(seqs.limit(0))).count()
