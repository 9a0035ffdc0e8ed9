"""Sequence functions as Column expressions: translation, scores, splice signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The genetic code, amino acids for the codons in the order AAA, AAC, AAG, AAT, ACA, ... TTT.
CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
AMINO = "ACDEFGHIKLMNPQRSTVWY"

# Substitution scores of all ordered pairs, rows and columns in the order of AMINO; anything else scores 0.
# The table isn't symmetric.
SCORES = [
    [ 4,  0, -2, -1, -2,  0, -2, -1, -1, -1, -1, -1, -1, -1, -1,  1, -1, -2, -3, -2],  # A
    [ 0,  9, -3, -4, -2, -3, -3, -1, -3, -1, -1, -3, -3, -3, -3, -1, -1, -1, -2, -2],  # C
    [-2, -3,  6,  2, -3, -1, -1, -3, -1, -4, -3,  1, -1,  0, -2,  0,  1, -3, -4, -3],  # D
    [-1, -4,  2,  5, -3, -2,  0, -3,  1, -3, -2,  0, -1,  2,  0,  0,  0, -3, -3, -2],  # E
    [-2, -2, -3, -3,  6, -3, -1,  0, -3,  0,  0, -3, -4, -3, -3, -2, -2, -1,  1,  3],  # F
    [ 0, -3, -1, -2, -3,  6, -2, -4, -2, -4, -3, -2, -2, -2, -2,  0,  1,  0, -2, -3],  # G
    [-2, -3,  1,  0, -1, -2,  8, -3, -1, -3, -2,  1, -2,  0,  0, -1,  0, -2, -2,  2],  # H
    [-1, -1, -3, -3,  0, -4, -3,  4, -3,  2,  1, -3, -3, -3, -3, -2, -2,  1, -3, -1],  # I
    [-1, -3, -1,  1, -3, -2, -1, -3,  5, -2, -1,  0, -1,  1,  2,  0,  0, -3, -3, -2],  # K
    [-1, -1, -4, -3,  0, -4, -3,  2, -2,  4,  2, -3, -3, -2, -2, -2, -2,  3, -2, -1],  # L
    [-1, -1, -3, -2,  0, -3, -2,  1, -1,  2,  5, -2, -2,  0, -1, -1, -1, -2, -1, -1],  # M
    [-2, -3,  1,  0, -3,  0, -1, -3,  0, -3, -2,  6, -2,  0,  0,  1,  0, -3, -4, -2],  # N
    [-1, -3, -1, -1, -4, -2, -2, -3, -1, -3, -2, -1,  7, -1, -2, -1,  1, -2, -4, -3],  # P
    [-1, -3,  0,  2, -3, -2,  0, -3,  1, -2,  0,  0, -1,  5,  1,  0,  0, -2, -2, -1],  # Q
    [-1, -3, -2,  0, -3, -2,  0, -3,  2, -2, -1,  0, -2,  1,  5, -1, -1, -3, -3, -2],  # R
    [ 1, -1,  0,  0, -2,  0, -1, -2,  0, -2, -1,  1, -1,  0, -1,  4,  1, -2, -3, -2],  # S
    [-1, -1,  1,  0, -2,  1,  0, -2,  0, -2, -1,  0,  1,  0, -1,  1,  4, -2, -3, -2],  # T
    [ 0, -1, -3, -2, -1, -3, -3,  3, -2,  1,  1, -3, -2, -2, -3, -2, -2,  4, -3, -1],  # V
    [-3, -2, -4, -3,  1, -2, -2, -3, -3, -2, -1, -4, -4, -2, -3, -3, -3, -3, 11,  2],  # W
    [-2, -2, -3, -2,  3, -3,  2, -1, -2, -1, -1, -2, -3, -1, -2, -2, -2, -1,  2,  7],  # Y
]


def letter_index(letters: str, c: Column) -> Column:
    """The place of ``c`` in ``letters``, from 0; -1 if it isn't there or is empty."""
    return F.when(F.length(c) == 1, F.call_function("instr", F.lit(letters), c) - 1).otherwise(-1)


def amino_score(a: Column, b: Column) -> Column:
    """The score of an ordered pair of residues; unknown residues score 0."""
    i, j = letter_index(AMINO, a), letter_index(AMINO, b)
    flat = F.array(*[F.lit(x) for row in SCORES for x in row])
    return F.when((i >= 0) & (j >= 0), F.element_at(flat, i * len(AMINO) + j + 1)).otherwise(0)


def codon(three: Column) -> Column:
    """The residue of three bases; X if one is unknown. U counts as T."""
    bases = F.translate(F.upper(three), "U", "T")
    base = [letter_index("ACGT", F.substr(bases, F.lit(k), F.lit(1))) for k in (1, 2, 3)]
    known = (base[0] >= 0) & (base[1] >= 0) & (base[2] >= 0)
    return F.when(known, F.substr(F.lit(CODONS), 16 * base[0] + 4 * base[1] + base[2] + 1, F.lit(1))).otherwise("X")


def translate_frame(nucl: Column, frame: int = 0) -> Column:
    """The whole codons of a reading frame (0, 1 or 2); empty if there is none.

    Codons of a batch are looked up in one table, as arrays; a lambda a codon would be interpreted.
    """

    @F.pandas_udf("string")
    def translated(texts: pd.Series) -> pd.Series:
        base = np.full(256, 4)
        for k, c in enumerate("ACGT"):
            base[[ord(c), ord(c.lower())]] = k
        base[[ord("U"), ord("u")]] = 3
        table = np.full((5, 5, 5), ord("X"), np.uint8)
        table[:4, :4, :4] = np.frombuffer(CODONS.encode(), np.uint8).reshape(4, 4, 4)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            x = base[np.frombuffer(text[frame:].encode("latin-1", "replace"), np.uint8)]
            n = len(x) // 3
            return table[tuple(x[: 3 * n].reshape(n, 3).T)].tobytes().decode()

        return pd.Series([one(t) for t in texts], dtype=object)

    return translated(nucl)


def reverse_complement(nucl: Column) -> Column:
    return F.reverse(F.translate(nucl, "ACGTacgt", "TGCAtgca"))


def orfs(protein: Column, least: int) -> Column:
    """Stretches between stops, of ``least`` residues or more."""
    return F.filter(F.split(protein, r"\*"), lambda x: F.length(x) >= least)


def splice_strengths(nucl: Column, fixed: bool = False) -> Column:
    """Strengths of the three-prime site at each base: 0.95 after AG or GT, 0.05 elsewhere, 0 at the ends.

    Both signals raise this one array; with ``fixed`` only AG does, and
    ``donor_strengths`` has GT.
    """
    signals = ("AG",) if fixed else ("AG", "GT")
    return _strengths(nucl, signals)


def donor_strengths(nucl: Column, fixed: bool = False) -> Column:
    """Strengths of the five-prime site; without ``fixed`` no signal raises them."""
    return _strengths(nucl, ("GT",) if fixed else ())


def _strengths(nucl: Column, signals: tuple[str, ...]) -> Column:
    chars = F.filter(F.split(F.upper(nucl), ""), lambda c: c != "")
    none = F.array(F.lit(""))
    before = F.concat(none, chars)
    after = F.concat(F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), none)

    def at(x: Column) -> Column:
        hit = F.concat(x["before"], x["own"]).isin(*signals) if signals else F.lit(False)
        return F.when((x["before"] == "") | (x["after"] == ""), F.lit(0.0)).when(hit, F.lit(0.95)).otherwise(F.lit(0.05))

    each = F.arrays_zip(chars.alias("own"), before.alias("before"), after.alias("after"))
    return F.transform(F.filter(each, lambda x: x["own"].isNotNull()), at)


def splice_score(p: Column) -> Column:
    """The score of a site of probability ``p``: 5 p squared."""
    return 5 * p * p


def percent_tenths(part: Column, whole: Column) -> Column:
    """A percentage cut (not rounded) to tenths."""
    return F.floor(1000 * part / whole) / 10


def wrap(text: Column, width: int) -> Column:
    """Lines of ``width`` characters, without a line end at the end."""
    return F.regexp_replace(F.regexp_replace(text, f"(.{{{width}}})", "$1\n"), "\n$", "")


def duration(seconds: Column) -> Column:
    """Seconds as text with days, hours, minutes and seconds."""
    s = seconds.cast("long")
    parts = (F.expr("86400L"), F.expr("3600L"), F.expr("60L"))
    d = F.floor(s / parts[0])
    h = F.floor(s % parts[0] / parts[1])
    m = F.floor(s % parts[1] / parts[2])
    return F.concat(d, F.lit("d "), h, F.lit("h "), m, F.lit("m "), s % parts[2], F.lit("s"))


def strand_label(chromosome: Column, strand: Column) -> Column:
    """The label of a chromosome, marked when it is read in reverse."""
    return F.when(strand < 0, F.concat(chromosome, F.lit("[revcomp]"))).otherwise(chromosome)


def mapping_notes(rearranged: Column, pct_id: Column, low: float = 90.0) -> Column:
    """What is to be said about a mapping: rearrangement, low identity; null if nothing."""
    a = F.when(rearranged, F.lit("chromosomal rearrangement implied"))
    b = F.when(pct_id < low, F.concat(F.lit("low quality mapping: "), pct_id.cast("string"), F.lit("% identity")))
    said = F.concat_ws("; ", a, b)
    return F.when(said != "", said)


def is_exon_case(c: Column) -> Column:
    """Whether a character is an exon's: upper case, where introns and flanks are in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def titled(name: Column) -> Column:
    """A species name for people: blanks for ``_``, each word with a capital, also behind an opening parenthesis; words with ``/`` stay."""
    words = F.split(F.replace(name, F.lit("_"), F.lit(" ")), " ")

    def word(w: Column) -> Column:
        first, rest = F.substring(w, 1, 1), F.substr(w, F.lit(2))
        inner = F.concat(F.lit("("), F.upper(F.substring(w, 2, 1)), F.substr(w, F.lit(3)))
        return F.when(first == "(", inner).when(w.contains("/"), w).otherwise(F.concat(F.upper(first), rest))

    return F.array_join(F.transform(words, word), " ")
