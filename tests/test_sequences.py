"""A planted genome: three-exon gene on both strands, its isoforms mapped and aligned; and the text readers."""

import random

import pytest

from isoweave.functions import bio
from isoweave.operators.align import GapCosts, align
from isoweave.plans import families
from isoweave.plans.families import merge_species
from isoweave.sources import text as sources
from isoweave.streaming.catalog import residue_counts

BACK = {}
for k, amino in enumerate(bio.CODONS):
    BACK.setdefault(amino, "ACGT"[k // 16] + "ACGT"[k // 4 % 4] + "ACGT"[k % 4])


def bases(rng, n):
    return "".join(rng.choice("ACT") for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    """Gene g1 forward on chr1, gene g2 reverse on chr2; each with three exons between GT...AG introns."""
    rng = random.Random(11)
    genome, marks, prots = {}, [], []
    for gene, chrom, strand in (("g1", "chr1", 1), ("g2", "chr2", -1)):
        exons = ["".join(rng.choice(bio.AMINO) for _ in range(30)) for _ in range(3)]
        dna, places = bases(rng, 200), []
        for e in exons:
            coded = "".join(BACK[a] for a in e)
            dna += "AG"
            places.append((len(dna) + 1, len(dna) + len(coded)))
            dna += coded + "GT" + bases(rng, 150)
        size = len(dna)
        if strand < 0:
            dna = dna[::-1].translate(str.maketrans("ACGT", "TGCA"))
            places = [(size + 1 - a, size + 1 - b) for a, b in places]
        genome[chrom] = dna
        marks += [(gene, chrom, strand, a, b, len(marks) + k) for k, (a, b) in enumerate(places)]
        prots += [(len(prots), gene, "".join(exons)), (len(prots) + 1, gene, exons[0] + exons[2]), (len(prots) + 2, gene, "W" * 40)]
    chunks = sources.chunked(spark.createDataFrame(list(genome.items()), "chr string, sequence string"), 128)
    sizes = spark.createDataFrame([(c, len(s)) for c, s in genome.items()], "chr string, size long")
    annotations = spark.createDataFrame(marks, "gene string, chr string, strand int, start long, end long, line_no long")
    proteins = spark.createDataFrame(prots, "seq_id long, gene string, residues string")
    return genome, chunks, sizes, annotations, proteins, prots


def test_mapping_recovers_every_codon(planted):
    genome, chunks, sizes, annotations, proteins, prots = planted
    mapped, misses = families.map_proteins(proteins, annotations, chunks, sizes, 128)
    rows = mapped.collect()
    where = {"g1": ("chr1", 1), "g2": ("chr2", -1)}
    for seq_id, gene, residues in prots:
        own = sorted((r for r in rows if r.seq_id == seq_id), key=lambda r: r.pos)
        if residues.startswith("WWWW"):
            assert not own
            continue
        chrom, strand = where[gene]
        dna = genome[chrom]
        told = ""
        for r in own:
            at = abs(r.pos) - 1
            codon = dna[at - 1 : at + 2]
            if strand < 0:
                codon = codon[::-1].translate(str.maketrans("ACGT", "TGCA"))
            told += bio.CODONS[16 * "ACGT".index(codon[0]) + 4 * "ACGT".index(codon[1]) + "ACGT".index(codon[2])]
        assert told == residues == "".join(r.ch for r in own)
    assert {(r.seq_id, r.reason) for r in misses.collect()} == {(2, "Unmapped"), (5, "Unmapped")}


def test_species_and_family_alignment(planted):
    _, chunks, sizes, annotations, proteins, prots = planted
    mapped, misses = families.map_proteins(proteins, annotations, chunks, sizes, 128)
    rows = families.align_species(mapped, misses, proteins).collect()
    own = {r.seq_id: r.aligned for r in rows}
    assert set(own) == {p[0] for p in prots}
    for seq_id, _, residues in prots:
        assert own[seq_id].replace("-", "").replace("/", "") == residues
    # the skipped exon is a gap of 30 columns between the same two boundaries
    assert own[1].count("-") - own[0].count("-") == 30


def test_alignment_of_equal_profiles():
    a, b, score = align(["/MKVLAT/"], ["/MKVLAT/"], GapCosts())
    assert a == b == ["/MKVLAT/"] and score > 0
    a, b, _ = align(["/MKVLAT/"], ["/MKAT/"], GapCosts(unspliced=True))
    assert len(a[0]) == len(b[0]) and b[0].replace("-", "") == "/MKAT/"


def test_readers(spark, tmp_path):
    fasta = tmp_path / "p.fa"
    fasta.write_text(">human|g1|1 # note\nMKT\n AAA\n\n>human|g1/g2|2\nMMM")
    got = {r.header: r.sequence for r in sources.read_fasta(spark, str(fasta)).collect()}
    assert got == {"human|g1|1 # note": "MKTAAA", "human|g1/g2|2": "MMM"}
    marks = tmp_path / "a.gtf"
    lines = ["# head", '1\tx\texon\t100\t180\t.\t+\t.\tgene_name "G1";', 'chr1\tx\tCDS\t100\t180\t.\t+\t.\tgene_name "g2";', 'chr1\tx\tgene\t1\t9\t.\t+\t.\tgene_name "g1";', 'chr1\tx\texon\t300\t390\t.\t-\t.\tgene_name "g1";', 'chr9\tx\texon\t3\t9\t.\t+\t.\tgene_name "g1";']
    marks.write_text("\n".join(lines) + "\n")
    sizes = spark.createDataFrame([("chr1", 1000)], "chr string, size long")
    rows = {(r.gene, r.chr, r.strand, r.start, r.end) for r in sources.read_annotations(spark, str(marks), sizes).collect()}
    assert rows == {("g1", "chr1", 1, 100, 180), ("g1", "chr1", -1, 390, 300)}
    tree, guide = sources.read_guide("(((mouse,rat),human),dog)\nHuman g/human.fa g/human.gtf\ndog g/dog.fa -\n")
    assert guide == [("human", "g/human.fa", "g/human.gtf"), ("dog", "g/dog.fa", None)]
    want = [("mouse", "rat"), ("mouse", "human"), ("mouse", "dog"), ("mouse", "cat"), ("mouse", "misc")]
    assert sources.merge_steps(tree, ["mouse", "rat", "human", "dog", "cat"]) == want
    for wrong in ("((a,b)", "a)(b"):
        with pytest.raises(ValueError):
            sources.merge_steps(wrong, ["a", "b"])


def test_merge_steps_follow_the_tree():
    assert sources.merge_steps("((a,b),((c,d),e));", list("abcde")) == [("a", "b"), ("c", "d"), ("c", "e"), ("a", "c"), ("a", "misc")]
    assert sources.merge_steps("((A:0.1,'b')x:2,(gone,c))", list("abc")) == [("a", "b"), ("a", "c"), ("a", "misc")]
    assert sources.merge_steps(None, ["b", "a"]) == [("a", "b"), ("a", "misc")] and sources.merge_steps(None, []) == []
    rng = random.Random(5)
    for _ in range(200):
        names = [f"s{k}" for k in range(rng.randint(2, 12))]
        nodes, clades = [(n, frozenset([n])) for n in names], set()
        while len(nodes) > 1:
            x, y = (nodes.pop(rng.randrange(len(nodes))) for _ in range(2))
            nodes.append((f"({x[0]},{y[0]})", x[1] | y[1]))
            clades.add(nodes[-1][1])
        held, made = {n: frozenset([n]) for n in [*names, "misc"]}, set()
        for into, source in sources.merge_steps(nodes[0][0], names):
            held[into] |= held.pop(source)
            made.add(held[into])
        assert made == clades | {frozenset([*names, "misc"])}


def test_merge_species_by_clades(spark):
    rows = [(s, "g", f"{s}{k}", q) for s, q in (("a", "MKTAYIAK"), ("b", "MKTAYIAK"), ("c", "MKTWYIAKQR"), ("d", "MKTWYIAKQR"), ("z", "MKTAYIAK")) for k in range(2)]
    rows += [("c", "h", "c0", "MKL"), ("d", "h", "d0", "MKL"), ("b", "h", "b0", "ML"), ("z", "one", "z0", "MAA")]
    df = spark.createDataFrame(rows, "species string, gene string, seq_id string, aligned string")
    got = merge_species(df, sources.merge_steps("((a,b),(c,d))", list("abcd"))).collect()
    assert sorted((r.gene, r.seq_id) for r in got) == sorted((g, i) for _, g, i, _ in rows)
    own = {(g, i): q for _, g, i, q in rows}
    for gene in ("g", "h", "one"):
        mine = sorted((r for r in got if r.gene == gene), key=lambda r: r.row_no)
        assert len({len(r.aligned) for r in mine}) == 1
        assert all(r.aligned.replace("-", "") == own[gene, r.seq_id] for r in mine)
        at = [r.seq_id[0] for r in mine]
        assert at == sorted(at)
    assert [r.seq_id for r in got if r.gene == "h" and r.row_no == 0] == ["b0"]


def test_streamed_counts(spark, tmp_path):
    rows = [("en", "g1", "MKT"), ("en", "g1", "MK"), ("de", "g2", "M")]
    df = spark.createDataFrame(rows, "species string, gene string, residues string")
    df.write.parquet(f"{tmp_path}/in")
    stream = residue_counts(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    key = lambda r: tuple(r)
    assert sorted(spark.table("counted").collect(), key=key) == sorted(residue_counts(df).collect(), key=key)


def test_merge_keeps_the_order_of_the_steps_where_species_are_missing(spark):
    rows = [(gene, sp, f"{gene}{sp}", "/ACDEF/") for gene, held in (("g1", "bz"), ("g2", "dbz"), ("g3", "acbzy"), ("g4", "z")) for sp in held]
    df = spark.createDataFrame(rows, "gene string, species string, seq_id string, aligned string")
    got = merge_species(df, [("a", "b"), ("c", "d"), ("a", "c")]).orderBy("gene", "row_no").collect()
    order = {g: "".join(r.seq_id[-1] for r in got if r.gene == g) for g in ("g1", "g2", "g3", "g4")}
    assert order == {"g1": "bz", "g2": "bdz", "g3": "abcyz", "g4": "z"}


def test_searches_map_what_the_seeds_miss(spark, planted):
    """A gene whose middle exon isn't annotated, one without annotations, one over two chromosomes, and nonsense."""
    genome, chunks, sizes, annotations, proteins, prots = planted
    rng = random.Random(12)
    novel = ["".join(rng.choice(bio.AMINO) for _ in range(40)) for _ in range(2)]
    coded = ["".join(BACK[a] for a in e) for e in novel]
    third = bases(rng, 300) + coded[0] + "GT" + bases(rng, 120) + "AG" + coded[1] + bases(rng, 300)
    genome = genome | {"chr3": third}
    chunks = sources.chunked(spark.createDataFrame(list(genome.items()), "chr string, sequence string"), 128)
    sizes = spark.createDataFrame([(c, len(x)) for c, x in genome.items()], "chr string, size long")
    partly = annotations.filter("not (gene = 'g1' and line_no = 1)")
    more = [*prots, (20, "g3", "".join(novel)), (21, "g3", novel[0] + prots[0][2][:30] + novel[1]), (22, "g1", "Y" * 30)]
    proteins = spark.createDataFrame(more, "seq_id long, gene string, residues string")
    maps, misses = families.map_with_search(proteins, partly, chunks, sizes, 128)
    assert {r.seq_id: r.method for r in maps.collect()} == {0: "guided_spliced", 1: "seed_weave", 3: "seed_weave", 4: "seed_weave", 20: "search_spliced"}
    mapped = families.mapped_residues(maps, proteins)
    rows = mapped.collect()
    for seq_id in (0, 1, 3, 4, 20):
        own = sorted((r for r in rows if r.seq_id == seq_id), key=lambda r: r.pos)
        residues = next(p[2] for p in more if p[0] == seq_id)
        assert "".join(r.ch for r in own) == residues, seq_id
        chrom, strand = {"g1": ("chr1", 1), "g2": ("chr2", -1), "g3": ("chr3", 1)}[own[0].gene]
        for r in own:
            at = abs(r.pos) - 1
            three = genome[chrom][at - 1 : at + 2]
            three = three if strand > 0 else three[::-1].translate(str.maketrans("ACGT", "TGCA"))
            right = len(three) == 3 and bio.CODONS[16 * "ACGT".index(three[0]) + 4 * "ACGT".index(three[1]) + "ACGT".index(three[2])] == r.ch
            assert right or sum(x.seq_id == seq_id for x in rows) > 60  # codons cut by a junction are read apart
    left = {r.seq_id: r.reason for r in misses.collect()}
    assert set(left) == {2, 5, 21, 22} and left[2] == left[5] == left[22] == "Unmapped" and left[21] in ("Chimeric", "Unmapped")
    aligned = families.align_species(mapped, misses, proteins).collect()
    assert {r.seq_id for r in aligned} == {p[0] for p in more}
