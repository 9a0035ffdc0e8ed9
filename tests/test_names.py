"""Unique ids where rows give ids that others would be made into."""

import collections
import random


def test_trees_are_repaired():
    import pytest

    from isoweave.sources.text import merge_steps, repaired_tree

    assert repaired_tree("( (a,b)(c d) ) ;") == "((a,b),(c,d))" and repaired_tree("a(b,c)") == "(a,(b,c))"
    assert repaired_tree("(a,(b,c)),d") == "((a,(b,c)),d)" and repaired_tree("(a:0.1,b)") == "(a:0.1,b)"
    for wrong in ("((a,b)", "a)(b", "(a,b))"):
        with pytest.raises(ValueError):
            repaired_tree(wrong)
    assert merge_steps("((a,b)(c d))", list("abcd"))[:3] == [("a", "b"), ("c", "d"), ("a", "c")]


def test_guides_names_and_profiles(spark, tmp_path):
    from pyspark.sql import functions as F

    from isoweave.functions import bio
    from isoweave.operators.msa import column_profile
    from isoweave.sources import text

    (tmp_path / "n").write_text("Homo sapiens = Human\nMus musculus=House Mouse\njunk\n")
    (tmp_path / "g.fa").write_text(">x\nA\n")
    names = text.species_names(spark, str(tmp_path / "n"))
    df = spark.createDataFrame([("homo_sapiens", "~/g.fa", None), ("rat", "g", "x.gtf")], "species string, genome_path string, gtf_path string")
    known = text.in_english(df, names)
    assert {r.species for r in known.collect()} == {"human", "rat"}
    assert text.guide_text(known, "(human,rat)") == "(human,rat)\nhuman  ~/g.fa  -\nrat    g  x.gtf\n"
    assert text.read_guide(text.guide_text(known, "(human,rat)")) == ("(human,rat)", [("human", "~/g.fa", None), ("rat", "g", "x.gtf")])
    assert text.checked_guide(spark, [("human", "~/g.fa", None)], home=str(tmp_path)) == [("human", f"{tmp_path}/g.fa", None)]
    one = spark.createDataFrame([("house_mouse (mus_x)", "a/b_cat")], "a string, b string").select(bio.titled(F.col("a")), bio.titled(F.col("b")), *[bio.is_exon_case(F.lit(c)) for c in ("A", "a", "-")]).first()
    assert tuple(one) == ("House Mouse (Mus X)", "a/b Cat", True, False, False)
    cells = spark.createDataFrame([(1, r, 0, c) for r, c in enumerate("ABBA")] + [(1, 9, 0, "C")], "g int, r int, col int, ch string")
    first = lambda **k: tuple(column_profile(cells, ["g"], **k).first())[2:]
    assert first() == (3, "A", 2) and first(prefer="B") == (3, "B", 2) and first(prefer="C") == (3, "A", 2) and first(ignore=F.col("r") == 0) == (3, "B", 2)


def test_made_ids_pass_over_given_ones(spark):
    from isoweave.operators.names import unique_ids

    rng = random.Random(1)
    pool = ["7", "7.1", "7.2", "7.1.1", "a", "a.1", "1", "2", None, "7.01", ".1"]
    rows = [(g, rng.choice(pool), i) for g in ("x", "y", None) for i in range(40)]
    got = unique_ids(spark.createDataFrame(rows, "g string, id string, n int"), ["g"], "id", ["n"]).collect()
    assert len(got) == len(rows)
    for g in ("x", "y", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.n)
        assert len({r.unique_id for r in own}) == len(own)
        given, seen, made = {r.id for r in own}, set(), collections.Counter()
        for r in own:
            if r.id is not None and r.id not in seen:
                seen.add(r.id)
                assert r.unique_id == r.id
                continue
            while True:
                made[r.id] += 1
                want = str(made[r.id]) if r.id is None else f"{r.id}.{made[r.id]}"
                if want not in given:
                    break
            assert r.unique_id == want
