"""Spliced alignment against a plain recursion, and planted genes in joined ranges of a genome."""

import functools
import random

import pytest

from isoweave.functions import bio
from isoweave.operators.spliced import SpliceCosts, align_spliced

AT = {c: k for k, c in enumerate(bio.AMINO)}
BACK = {}
for k, amino in enumerate(bio.CODONS):
    BACK.setdefault(amino, "ACGT"[k // 16] + "ACGT"[k // 4 % 4] + "ACGT"[k % 4])


def amino(codon):
    return bio.CODONS[16 * "ACGT".index(codon[0]) + 4 * "ACGT".index(codon[1]) + "ACGT".index(codon[2])]


def score(codon, residue):
    a = amino(codon)
    return -(10**9) if a == "*" else bio.SCORES[AT[a]][AT[residue]]


def plain(protein, dna, costs):
    """The best score: by residues from the left, each with its codon whole or cut by an intron, or left out; then an intron, then inserted codons."""
    introns = [(k, j, costs.intron + (0 if dna[k : k + 2] == "GT" else costs.rare_donor)) for k in range(len(dna)) if dna[k : k + 2] in ("GT", "GC") for j in range(k + costs.shortest, len(dna) + 1) if dna[j - 2 : j] == "AG"]
    none = -(10**9)

    @functools.cache
    def omitted(i, j):
        return max(inserted(i - 1, j) + costs.open, omitted(i - 1, j) + costs.extend) if i else none

    @functools.cache
    def body(i, j):
        best = omitted(i, j)
        if j >= 3:
            best = max(best, inserted(i - 1, j - 3) + score(dna[j - 3 : j], protein[i - 1]))
        for k, to, cost in introns:
            if to + 2 == j and k >= 1:
                best = max(best, inserted(i - 1, k - 1) + cost + score(dna[k - 1] + dna[to : to + 2], protein[i - 1]))
            if to + 1 == j and k >= 2:
                best = max(best, inserted(i - 1, k - 2) + cost + score(dna[k - 2 : k] + dna[to], protein[i - 1]))
        return best

    @functools.cache
    def between(i, j):
        return max([body(i, j), *(body(i, k) + cost for k, to, cost in introns if to == j)]) if i else 0

    @functools.cache
    def inserted(i, j):
        if i == 0:
            return 0
        best, cost = between(i, j), costs.open - costs.extend
        for k in range(j - 3, -1, -3):
            cost += costs.stop if amino(dna[k : k + 3]) == "*" else costs.extend
            best = max(best, between(i, k) + cost)
        return best

    return max(body(len(protein), j) for j in range(len(dna) + 1))


def rescored(protein, dna, codons, costs):
    """The score of a traced alignment, from its codons alone."""
    total, last, gone = 0, None, 0
    for r, c in zip(protein, codons, strict=True):
        if c is None:
            total += costs.extend if gone else costs.open
            gone += 1
            continue
        gone = 0
        total += score("".join(dna[k] for k in c), r)
        for a, b in ((c[0], c[1]), (c[1], c[2])):
            if b > a + 1:
                assert dna[a + 1 : a + 3] in ("GT", "GC") and dna[b - 2 : b] == "AG" and b - a - 1 >= costs.shortest
                total += costs.intron + (0 if dna[a + 1 : a + 3] == "GT" else costs.rare_donor)
        last = c[2]
    assert last is None or all(x < y for x, y in zip(sum((c for c in codons if c), ()), sum((c for c in codons if c), ())[1:]))
    return total


def test_score_equals_a_plain_recursion():
    rng = random.Random(1)
    costs = SpliceCosts(open=-4, extend=-1, intron=-3, rare_donor=-2, stop=-50, shortest=5)
    split = set()
    for n in range(250):
        protein = "".join(rng.choice(bio.AMINO) for _ in range(rng.randint(1, 5)))
        if n % 2:
            dna = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        else:
            coded, out = "".join(BACK[a] for a in protein), ""
            for k, b in enumerate(coded):
                out += b + ("GT" + "".join(rng.choice("ACT") for _ in range(rng.randint(1, 6))) + "AG" if rng.random() < 0.12 else "") + ("ACA" if k % 3 == 2 and rng.random() < 0.1 else "")
            dna = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 6))) + out
        got, codons, exons = align_spliced(protein, dna, costs)
        assert got == plain(protein, dna, costs), (protein, dna)
        split |= {(c[1] - c[0] > 1, c[2] - c[1] > 1) for c in codons if c}
        assert exons == sorted(exons) and (not exons or exons[0] in (0, 1))
        if None not in codons:
            assert rescored(protein, dna, codons, costs) >= got  # introns between codons and inserted codons cost more
    assert {(True, False), (False, True), (False, False)} <= split
    assert align_spliced("", "ACGT") == (0, [], []) and align_spliced("MK", "") == (0, [None, None], [0, 0])


def planted(rng, exons, phase):
    """Bases of a gene whose introns cut codons after ``phase`` bases, and the places of its codons."""
    coded = "".join(BACK[a] for e in exons for a in e)
    cuts = [3 * len("".join(exons[: k + 1])) + phase for k in range(len(exons) - 1)]
    out, places = "".join(rng.choice("ACT") for _ in range(60)), []
    for k, b in enumerate(coded):
        if k in cuts:
            out += "GT" + "".join(rng.choice("ACT") for _ in range(rng.randint(60, 200))) + "AG"
        places.append(len(out))
        out += b
    return out + "".join(rng.choice("ACT") for _ in range(60)), [tuple(places[k : k + 3]) for k in range(0, len(places), 3)]


@pytest.mark.parametrize("phase", [0, 1, 2])
def test_planted_genes_are_recovered_in_every_phase(phase):
    rng = random.Random(20 + phase)
    for n in (30, 12, 200):
        exons = ["".join(rng.choice(bio.AMINO) for _ in range(n)) for _ in range(3)]
        dna, codons = planted(rng, exons, phase)
        _, got, exon = align_spliced("".join(exons), dna)
        right = sum(a == b for a, b in zip(got, codons, strict=True))
        assert right >= len(codons) - 4 and None not in got  # a junction may stand a base or two aside at the same score
        assert max(exon) == 2 and exon.count(1) in range(n - 2, n + 3)


def test_spliced_maps_return_to_the_genome(spark):
    from isoweave.operators.spliced import spliced_maps
    from isoweave.sources.text import chunked

    rng = random.Random(5)
    exons = ["".join(rng.choice(bio.AMINO) for _ in range(25)) for _ in range(2)]
    back = str.maketrans("ACGT", "TGCA")
    genome, want = {}, {}
    for chrom, strand, phase in (("chr1", 1, 1), ("chr2", -1, 1)):
        gene, codons = planted(rng, exons, phase)
        pad = "".join(rng.choice("ACT") for _ in range(500))
        dna = pad + gene + pad
        centres = [500 + c[1] + 1 for c in codons]
        if strand < 0:
            centres = [len(dna) + 1 - x for x in centres]
            dna = dna[::-1].translate(back)
        genome[chrom], want[chrom] = dna, centres
    chunks = chunked(spark.createDataFrame(list(genome.items()), "chr string, sequence string"), 128)
    protein = "".join(exons)
    seqs = spark.createDataFrame([(1, protein, "x"), (2, "W" * 50, "x"), (3, protein[:25] + "W" * 6 + protein[31:], "x")], "seq_id long, residues string, chr string")
    n1, n2 = len(genome["chr1"]), len(genome["chr2"])
    half = (want["chr1"][24] + want["chr1"][26]) // 2 + 25  # within the intron
    rows = [(s, 1, 0, "chr1", 301, n1 - 300) for s in (1, 2, 3)] + [(1, 2, 0, "chr2", n2 - 300, 301)]
    rows += [(1, 3, 0, "chr1", 301, half), (1, 3, 1, "chr1", half + 1, n1 - 200)]
    rows += [(1, 4, 0, "chr1", 301, half), (1, 4, 1, "chr2", want["chr2"][25] + 30, 201)]
    rows += [(1, 5, 0, "chr2", 301, n2 - 300)]  # the wrong strand
    searches = spark.createDataFrame(rows, "seq_id long, search long, part int, chr string, a long, b long")
    got = {(r.seq_id, r.search): r for r in spliced_maps(seqs, searches, chunks, 90.0, 128).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4)}
    centres = lambda r: [x for e in r.exons for x in e.centres]
    near = lambda x, y: len(x) == len(y) and sum(a == b for a, b in zip(x, y)) >= len(x) - 1
    assert near(centres(got[1, 1]), want["chr1"]) and near(centres(got[1, 3]), want["chr1"]) and near(centres(got[1, 2]), want["chr2"])
    assert got[1, 1].chr == "chr1" and got[1, 2].chr == "chr2[revcomp]" and not got[1, 2].chimeric and got[1, 1].pct_id >= 98
    assert got[1, 4].chr == "Chimeric:chr1/chr2[revcomp]" and got[1, 4].chimeric and not got[1, 4].rearranged
    e = got[1, 1].exons
    assert (e[0].a_start, e[-1].a_end, e[0].strand) == (0, 49, 1) and e[0].n_start == want["chr1"][0] - 1 and e[-1].n_end == want["chr1"][-1] + 1
    low = {(r.seq_id, r.search): r for r in spliced_maps(seqs, searches, chunks, 75.0, 128).collect()}
    assert (3, 1) in low and low[3, 1].note == "low quality mapping: 88.0% identity"
