"""Spliced alignments as text: rendered in groups of lines, and read back.

An alignment begins with a line ``ALIGNMENT``.  A group of four lines shows a blank
line, then the translation, the bases (upper case within exons) and the residues of
``WIDTH`` places; the last two begin with the number of their first base or residue
and end in ``|``.  ``;; skip n nt`` stands in place of the group's second line where n
bases of an intron are passed over.  The reader counts bases itself and compares
its count with the numbers in the text: after a skip its count holds, unless the
text shows that a skip of 60 didn't take place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from isoweave.functions.bio import CODONS
from isoweave.operators.grouped import map_groups

WIDTH, LONG_INTRON, SHOWN = 60, 180, 30
MAPS = "reason string, pct_id double, exons array<struct<a_start:int,a_end:int,n_start:bigint,n_end:bigint,centres:array<bigint>>>"


def _amino(three: str) -> str:
    at = ["ACGT".find(c) for c in three.upper().replace("U", "T")]
    return "X" if min(at) < 0 else CODONS[16 * at[0] + 4 * at[1] + at[2]]


def render(protein: str, bases: str, codons: list[tuple[int, int, int]]) -> list[str]:
    """The lines of an alignment in which every residue has a codon (the places of its bases, from 0).

    A codon's residue and amino stand at its middle base.  Introns of over
    ``LONG_INTRON`` bases are shown at their ends only.
    """
    first, last = codons[0][0], codons[-1][2]
    used = {p: k for k, c in enumerate(codons) for p in c}
    middle = {c[1]: k for k, c in enumerate(codons)}
    spans, p = [], first  # what is shown, in pieces between skips
    start = first
    while p <= last:
        if p not in used:
            end = p
            while end not in used:
                end += 1
            if end - p > LONG_INTRON:
                spans.append((start, p + SHOWN))
                start = end - SHOWN
            p = end
        else:
            p += 1
    spans.append((start, last + 1))
    lines, residue = ["ALIGNMENT", ""], 1
    for n, (a, b) in enumerate(spans):
        if n:
            lines += ["", f";; skip {a - spans[n - 1][1]} nt"]
        for at in range(a, b, WIDTH):
            own = range(at, min(at + WIDTH, b))
            trans = "".join(_amino("".join(bases[x] for x in codons[middle[k]])) if k in middle else " " for k in own)
            nucls = "".join(bases[k].upper() if k in used else bases[k].lower() for k in own)
            prot = "".join(protein[middle[k]].upper() if k in middle else " " for k in own)
            lines += ["", " " * 8 + trans, f"{at + 1:7d} {nucls}| bases", f"{residue:7d} {prot}| protein"]
            residue += len(prot.replace(" ", ""))
    return [*lines, "", "//"]


def parse(lines: list[str], protein: str) -> tuple[str | None, float | None, list[dict]]:
    """(reason, percent identity, exons): the reason why an alignment is no map, or None.

    Exons have residues (from 1), bases (from 1) and the middle bases of their codons.
    """
    at = next((k for k, x in enumerate(lines) if x.startswith("ALIGNMENT")), None)
    if at is None:
        return "no alignment", None, []
    # groups of places that follow on one another: (first base, [(amino, base, residue)])
    groups: list[tuple[int, int, list[tuple[str, str, str]]]] = []
    k, counted, skipped = at + 2, 0, -1
    while k + 1 < len(lines):
        second = lines[k + 1]
        if skip := re.match(r";; skip (\d+)", second):
            skipped = int(skip[1])
            k += 2
            continue
        if k + 3 >= len(lines):
            break
        shown = re.match(r"\s*(\d+) ([^|]*)\|", lines[k + 2])
        residues = re.match(r"\s*(\d+) ", lines[k + 3])
        if not shown or not residues:
            return "broken group", None, []
        if skipped:
            said = int(shown[1])
            if skipped == -1 or counted + skipped == said or (skipped == 60 and said == counted):
                counted = said
            else:
                counted += skipped
            groups.append((counted, int(residues[1]), []))
            skipped = 0
        lo, hi = shown.span(2)
        for j in range(lo, hi):
            pick = lambda x: x[j] if j < len(x) else " "  # noqa: B023, E731
            base = pick(lines[k + 2])
            if not base.isspace():
                groups[-1][2].append((pick(second), base, pick(lines[k + 3])))
                counted += base.isalpha()
        k += 4
    exons, same, unlike = [], 0, 0
    for base_no, residue_no, places in groups:
        own: list[int] = []
        start, first_residue = None, residue_no
        for amino, base, residue in [*places, ("", "a", "")]:  # a lower-case end closes the last exon
            if base.islower():
                if own:
                    exons.append({"a_start": first_residue, "a_end": residue_no - 1, "n_start": start, "n_end": base_no - 1, "centres": own})
                own, start = [], None
            else:
                if start is None:
                    start, first_residue = base_no, residue_no
                if residue.isalpha() and residue.isupper():
                    equal = residue == amino or (residue == "S" and amino == "J")
                    same, unlike = same + equal, unlike + (not equal)
                    own.append(base_no)
                    residue_no += 1
            base_no += base.isalpha()
    if not same:
        return "no match", None, []
    if same + unlike != len(protein):
        return "not the whole protein", None, []
    return None, int(1000.0 * same / (same + unlike)) / 10.0, exons


def spliced_texts(lines: DataFrame, proteins: DataFrame) -> DataFrame:
    """seq_id, reason, pct_id, exons of alignments given as lines (seq_id, line_no, line); one alignment is held at a time."""
    kind = dict(lines.dtypes)["seq_id"]

    def run(rows: list[tuple]) -> Iterator[tuple]:
        yield rows[0][0], *parse([r[2] or "" for r in rows], rows[0][3] or "")

    joined = lines.select("seq_id", "line_no", "line").join(proteins.select("seq_id", "residues"), "seq_id")
    return map_groups(joined, ["seq_id"], ["line_no"], run, f"seq_id {kind}, {MAPS}")
