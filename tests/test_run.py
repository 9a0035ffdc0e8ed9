"""A whole run over a planted clade: two species with genomes, one without; its files read back."""

import random

import pytest

from isoweave.functions import bio
from isoweave.plans.run import RunOptions, run
from isoweave.sources import files

BACK = {}
for k, amino in enumerate(bio.CODONS):
    BACK.setdefault(amino, "ACGT"[k // 16] + "ACGT"[k // 4 % 4] + "ACGT"[k % 4])


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    rng = random.Random(31)
    bases = lambda n: "".join(rng.choice("ACT") for _ in range(n))
    folder = tmp_path_factory.mktemp("inputs")
    exons = {g: ["".join(rng.choice(bio.AMINO) for _ in range(30)) for _ in range(3)] for g in ("g1", "g2")}
    proteins, marks = [], {}
    for species, strand in (("human", 1), ("mouse", -1)):
        dna, lines = bases(200), []
        for gene, parts in exons.items():
            for k, e in enumerate(parts):
                dna += "AG"
                first = len(dna) + 1
                dna += "".join(BACK[a] for a in e)
                lines.append((gene, k, first, len(dna)))
                dna += "GT" + bases(150)
        n = len(dna)
        if strand < 0:
            dna = dna[::-1].translate(str.maketrans("ACGT", "TGCA"))
            lines = [(g, k, n + 1 - b, n + 1 - a) for g, k, a, b in lines]
        (folder / f"{species}.fa").write_text(f">chr1 whole\n{dna[:70]}\n{dna[70:]}\n>chr2\n{bases(100)}\n")
        # the second gene of mouse isn't annotated
        marks[species] = "# annotations\n" + "".join(f'chr1\tx\texon\t{a}\t{b}\t.\t{"+" if strand > 0 else "-"}\t.\tgene_name "{g.upper()}";\n' for g, _, a, b in lines if (species, g) != ("mouse", "g2"))
        (folder / f"{species}.gtf").write_text(marks[species])
        for gene, parts in exons.items():
            proteins.append((f"{species}|{gene}|1", "".join(parts)))
            proteins.append((f"{species}|{gene}|2 # short", (parts[0] + parts[2]).lower()))
    proteins += [("human|g1|x", "W" * 30), ("newt|g1|1", exons["g1"][0] + exons["g1"][1]), ("newt|g3|1", "MKWVTFISLL"), ("not a name", "MK")]
    (folder / "p.fa").write_text("\n".join(f">{n}\n{s[:40]}\n{s[40:]}" for n, s in proteins) + "\n")
    (folder / "guide").write_text(f"(human,mouse)\nhuman {folder}/human.fa {folder}/human.gtf\nmouse {folder}/mouse.fa {folder}/mouse.gtf\nrat {folder}/human.fa -\n")
    return folder, {n: s for n, s in proteins if n != "not a name"}


def test_a_run_leaves_alignments_maps_and_misses(spark, inputs, tmp_path):
    folder, proteins = inputs
    out = tmp_path / "out"
    assert run(spark, str(folder / "p.fa"), str(folder / "guide"), str(out), RunOptions(chunk=256)) == ["human", "mouse", "misc"]
    found = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()}
    assert found == {f"Final-MSAs/g{k}.afa" for k in (1, 2, 3)} | {f"Species-MSAs/{s}/{kind}" for s in ("human", "mouse") for kind in ("alignments/g1.afa", "alignments/g2.afa", "mappings/g1.out", "mappings/g2.out")} | {
        "Species-MSAs/misc/alignments/g1.afa", "Species-MSAs/misc/alignments/g3.afa", "Mapping-Misses/human.misses", "Mapping-Misses/misc.misses"}
    rows = files.read_alignments(spark, f"{out}/Final-MSAs/*.afa").collect()
    assert {r.title: r.aligned.replace("-", "").replace("/", "") for r in rows} == proteins
    for gene in ("g1", "g2", "g3"):
        own = [r for r in rows if r.file.endswith(f"{gene}.afa")]
        assert len({len(r.aligned) for r in own}) == 1
    g2 = {r.title: r.aligned.strip("/") for r in rows if r.file.endswith("g2.afa")}
    assert g2["human|g2|1"] == g2["mouse|g2|1"] == proteins["human|g2|1"] and g2["human|g2|2 # short"] == proteins["human|g2|2 # short"][:30] + "-" * 30 + proteins["human|g2|2 # short"][30:]
    assert [r.title for r in sorted((r for r in rows if r.file.endswith("g2.afa")), key=lambda r: r.row_no)][:2] == ["human|g2|1", "human|g2|2 # short"]
    text = (out / "Species-MSAs/mouse/mappings/g2.out").read_text()
    assert text.startswith("Canonical Chromosome: chr1") and text.count("Sequence ID: mouse|g2|") == 2 and "Map Method : search_spliced" in text and "chr1[revcomp]:" in text
    assert "Map Method : seed_weave" in (out / "Species-MSAs/human/mappings/g1.out").read_text()
    assert (out / "Mapping-Misses/human.misses").read_text() == "g1: Unmapped: human|g1|x\n"
    composed = files.read_alignments(spark, f"{out}/Species-MSAs/human/alignments/g2.afa").collect()
    assert all(r.aligned.count("/") == 4 for r in composed)


def test_maps_only(spark, inputs, tmp_path):
    folder, _ = inputs
    out = tmp_path / "maps"
    assert run(spark, str(folder / "p.fa"), str(folder / "guide"), str(out), RunOptions(only_map=True, search=False, chunk=256)) == ["human", "mouse"]
    found = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()}
    assert found == {"Mappings-by-Gene/g1/human.mappings", "Mappings-by-Gene/g1/mouse.mappings", "Mappings-by-Gene/g2/human.mappings", "Mappings-by-Gene/g1/human.misses", "Mappings-by-Gene/g2/mouse.misses", "Mapping-Misses/human.misses", "Mapping-Misses/mouse.misses"}
    assert (out / "Mappings-by-Gene/g2/mouse.misses").read_text() == "g2: Unmapped: mouse|g2|1\ng2: Unmapped: mouse|g2|2 # short\n"


def test_a_guide_with_missing_files_is_an_error(spark, inputs, tmp_path):
    folder, _ = inputs
    (tmp_path / "guide").write_text(f"human {folder}/gone.fa -\nhuman {folder}/human.fa {folder}/gone.gtf\n")
    with pytest.raises(ValueError, match="gone.fa.*gone.gtf.*human: listed twice"):
        run(spark, str(folder / "p.fa"), str(tmp_path / "guide"), str(tmp_path / "out"))
