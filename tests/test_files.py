"""Files that appear whole or not at all, their contents read back, numbering, and spliced alignments as text."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from isoweave.functions import bio
from isoweave.operators.spliced import align_spliced
from isoweave.sources import files, spliced_text
from isoweave.sources.text import read_fasta

BACK = {}
for k, amino in enumerate(bio.CODONS):
    BACK.setdefault(amino, "ACGT"[k // 16] + "ACGT"[k // 4 % 4] + "ACGT"[k % 4])


def tree(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()}


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    writer = files.WholeFileWriter(str(tmp_path / "out"), "r", False)
    lost = writer.write(iter([Row(name="a/x.fa", body="half"), Row(name="a/y.fa", body="half")]))
    good = writer.write(iter([Row(name="a/x.fa", body=">1\nMK\n"), Row(name="b/z.fa", body=None)]))
    assert len(lost.files) == 2 and not (tmp_path / "out/a").exists()
    writer.commit([good, None])
    assert tree(tmp_path / "out") == {"a/x.fa", "b/z.fa"}
    assert (tmp_path / "out/a/x.fa").read_text() == ">1\nMK\n" and (tmp_path / "out/b/z.fa").read_text() == ""
    again = writer.write(iter([Row(name="a/x.fa", body="new")]))
    writer.abort([again])
    assert tree(tmp_path / "out") == {"a/x.fa", "b/z.fa"} and (tmp_path / "out/a/x.fa").read_text() != "new"
    with pytest.raises(ValueError, match="several"):
        writer.commit([writer.write(iter([Row(name="q", body="1")])), writer.write(iter([Row(name="q", body="2")]))])
    assert tree(tmp_path / "out") == {"a/x.fa", "b/z.fa"}


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    df = spark.range(8).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise("text").alias("body"))
    with pytest.raises(Exception, match="lost"):
        files.write_files(df, str(tmp_path / "out"))
    assert tree(tmp_path) == set()
    files.write_files(df.filter("id <> 5"), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == {f"f{k}" for k in range(8) if k != 5}


def test_what_is_read_back_is_what_was_written(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("ACDEFacdef") for _ in range(n))
    rows = [(k, sp, gene, f"{sp}|{gene}|{k}" + (" # note" if k % 2 else ""), text(rng.choice([1, 59, 60, 61, 240, 500]))) for k, (sp, gene) in enumerate((s, g) for s in ("human", "mouse") for g in ("g1", "../g2", "g/3") for _ in range(3))]
    p = spark.createDataFrame(rows, "seq_id long, species string, gene string, orig_name string, residues string")
    out = str(tmp_path / "out")
    files.write_files(files.family_files(p), out)
    assert tree(tmp_path / "out") == {f"{s}/seqs/{g}.fa" for s in ("human", "mouse") for g in ("g1", "-._g2", "g_3")}
    got = {int(r.header): r.sequence for r in read_fasta(spark, out + "/*/seqs/*.fa").collect()}
    assert got == {r[0]: r[4] for r in rows}
    assert max(map(len, (tmp_path / "out/human/seqs/g1.fa").read_text().split("\n"))) <= 240

    # alignments: the case of the residues, titles with frames, 60 columns, one file a gene
    upper = p.select("seq_id", "species", "gene", "residues", F.row_number().over(files.Window.partitionBy("species", "gene").orderBy("seq_id")).alias("row_no"), F.concat(F.lit("/"), F.rpad(F.upper("residues"), 500, "-"), F.lit("/")).alias("aligned"))
    labels = spark.createDataFrame([(0, "ARF:1..2"), (1, "ARFs:1..2,4..5")], "seq_id long, label string")
    rows_out = files.restore_case(files.named_rows(upper, p, labels))
    files.write_files(files.alignment_files(rows_out, files.file_name(F.col("species"), "alignments", F.concat("gene", F.lit(".afa")))), out)
    back = files.read_alignments(spark, out + "/*/alignments/*.afa").collect()
    assert {r.title: r.aligned.strip("/").replace("-", "") for r in back} == {r[3] + {0: " #ARF:1..2", 1: " ARFs:1..2,4..5"}.get(r[0], ""): r[4] for r in rows}
    assert {len(r.aligned) for r in back} == {502} and {r.row_no for r in back} == {0, 1, 2}
    files.write_files(spark.createDataFrame([("bare.afa", ">x\nAB-\n>y\n-BC\n")], "name string, body string"), out)
    assert [(r.title, r.aligned) for r in files.read_alignments(spark, out + "/bare.afa").orderBy("row_no").collect()] == [("x", "/AB-/"), ("y", "/-BC/")]

    exons = [(0, 4, "chr1", -1, 900, 886, [899, 896, 893, 890, 887])]
    maps = spark.createDataFrame([(7, "g1", "human|g1|7", "seed_weave", "chr1[revcomp]", None, exons), (8, "g1", "human|g1|8", "search_spliced", "Chimeric:a/b", "chromosomal rearrangement implied; low quality mapping: 80.1% identity", exons)], "seq_id long, gene string, title string, method string, chr string, note string, exons array<struct<a_start:int,a_end:int,chr:string,strand:int,n_start:long,n_end:long,centres:array<long>>>")
    files.write_files(files.mapping_files(maps, files.file_name("m", F.concat("gene", F.lit(".out"))), F.lit("chr1[revcomp]")), out)
    assert (tmp_path / "out/m/g1.out").read_text() == (
        "Canonical Chromosome: chr1[revcomp]\n\nSequence ID: human|g1|7\nMap Method : seed_weave\nChromosome : chr1[revcomp]\nNum Exons  : 1\n* Aminos 1..5, chr1[revcomp]:900..886\n899,896,893,890,887\n\n"
        "Sequence ID: human|g1|8\nMap Method : search_spliced\nChromosome : Chimeric:a/b # chromosomal rearrangement implied # low quality mapping: 80.1% identity\nNum Exons  : 1\n* Aminos 1..5, chr1[revcomp]:900..886\n899,896,893,890,887\n\n"
    )
    misses = spark.createDataFrame([(2, "g2", "Unmapped", "human|g2|2"), (1, "g1", "Noncanonical", "human|g1|1")], "seq_id long, gene string, reason string, title string")
    files.write_files(files.miss_files(misses, files.file_name("human.misses")), out)
    assert (tmp_path / "out/human.misses").read_text() == "g1: Noncanonical: human|g1|1\ng2: Unmapped: human|g2|2\n"
    framed = spark.createDataFrame([(1, "s1", "ARF:3..9"), (0, "s0", "ARFs:1..2,5..8")], "seq_id long, title string, label string")
    files.write_files(files.frame_files(framed, files.file_name("f")), out)
    assert (tmp_path / "out/f").read_text() == "s0\n- Amino acids 1..2,5..8 identified as alternative reading frames\n\ns1\n- Amino acids 3..9 identified as an alternative reading frame\n\n"


def test_rows_are_numbered_in_the_order_of_their_files(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for k, n in enumerate((400, 50, 0, 900)):
        lines = [f"{k}-{i}-" + "x" * rng.randint(0, 200) for i in range(n)]
        (tmp_path / f"part{k}.txt").write_text("\n".join(lines) + ("\n" if lines else ""))
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        text = spark.read.text(str(tmp_path))
        got = files.numbered(text).collect()
        assert text.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.value for r in sorted(got, key=lambda r: r.seq_id)] == want and sorted(r.seq_id for r in got) == list(range(len(want)))


def test_prepared_files(spark, tmp_path):
    rows = [("human|g1|1", "simple", "human", "g1", "1", "MK"), ("Human|g1|1", "simple", "human", "g1", "1.1", "MKK"), ("junk", "reject", None, None, None, "M" * 70)]
    df = spark.createDataFrame(rows, "header string, dialect string, species string, gene string, unique_id string, residues string")
    assert files.prepared_files(df, str(tmp_path)) == {"prepared.fa": 2, "name-changes.out": 1, "unparseable.out": 1}
    assert {(r.header, r.sequence) for r in read_fasta(spark, str(tmp_path / "prepared.fa")).collect()} == {("human|g1|1", "MK"), ("human|g1|1.1", "MKK")}
    assert spark.read.text(str(tmp_path / "name-changes.out")).first().value == "Human|g1|1 --> human|g1|1.1"


def alignment(rng, n, phase, long=False):
    exons = ["".join(rng.choice(bio.AMINO) for _ in range(n)) for _ in range(3)]
    coded = "".join(BACK[a] for e in exons for a in e)
    out = "".join(rng.choice("ACT") for _ in range(25))
    for k, b in enumerate(coded):
        if k in (3 * n + phase, 6 * n + phase):
            out += "GT" + "".join(rng.choice("ACT") for _ in range(400 if long else 70)) + "AG"
        out += b
    out += "".join(rng.choice("ACT") for _ in range(25))
    return "".join(exons), out, align_spliced("".join(exons), out)[1]


def test_spliced_text_round_trip(spark):
    rng = random.Random(3)
    rows, proteins, want = [], [], {}
    for n in range(12):
        protein, dna, codons = alignment(rng, rng.randint(8, 50), n % 3, long=n % 2 == 0)
        lines = spliced_text.render(protein, dna, codons)
        assert (";; skip" in "\n".join(lines)) == (n % 2 == 0)
        proteins.append((n, protein))
        want[n] = [c[1] + 1 for c in codons]
        if n == 10:  # a skip of 60 that didn't take place: the text's number counts
            at = next(k for k, x in enumerate(lines) if x.startswith("        ") and k > 6)
            lines[at - 1 : at - 1] = ["", ";; skip 60 nt"]
        rows += [(n, k, x) for k, x in enumerate(lines)]
    protein, dna, codons = alignment(rng, 20, 0)
    lines = spliced_text.render(protein, dna, codons)
    proteins += [(50, protein), (51, protein + "M"), (52, protein), (53, "W")]
    rows += [(50, k, x.replace("|", " ") if k > 8 else x) for k, x in enumerate(lines)] + [(51, k, x) for k, x in enumerate(lines)] + [(52, 0, "nothing"), (53, 0, "ALIGNMENT"), (53, 1, None)]
    got = {r.seq_id: r for r in spliced_text.spliced_texts(spark.createDataFrame(rows, "seq_id long, line_no int, line string"), spark.createDataFrame(proteins, "seq_id long, residues string")).collect()}
    for n, centres in want.items():
        assert got[n].reason is None and [x for e in got[n].exons for x in e.centres] == centres and got[n].pct_id == 100.0, n
        assert [e.a_start for e in got[n].exons][0] == 1 and got[n].exons[-1].a_end == len(centres) and len(got[n].exons) == (4 if n == 10 else 3)
        for a, b in zip(got[n].exons, got[n].exons[1:]):
            assert b.a_start == a.a_end + 1 and a.n_end < b.n_start
    assert {n: got[n].reason for n in (50, 51, 52, 53)} == {50: "broken group", 51: "not the whole protein", 52: "no alignment", 53: "no match"}
