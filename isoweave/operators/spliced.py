"""Spliced alignment of proteins to genome ranges, and its way back to genome coordinates.

The kernel aligns a whole protein to codons of a stretch of bases: substitution
scores, affine gaps of whole codons, and introns from GT (or GC) to AG of at least
``shortest`` bases, which may cut a codon after its first or second base.  Ends of
the stretch are free.  Rows are filled residue by residue over all bases at once;
donors and acceptors stand in short lists, over which a running maximum finds the
best donor of each acceptor.  Only each ``sqrt(length)``-th row is kept, and a block
of rows is filled again for the trace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoweave.functions.bio import AMINO, CODONS, SCORES, mapping_notes, percent_tenths, strand_label
from isoweave.operators.durable import kept
from isoweave.operators.grouped import map_groups
from isoweave.operators.intervals import as_of, drop_repeats, out_of_order, running_offsets
from isoweave.operators.mapping import implausible
from isoweave.sources.text import fetch

NEVER = -(10**8)
STOP, UNKNOWN = 21, 20


@dataclass(frozen=True)
class SpliceCosts:
    open: int = -11
    extend: int = -1
    intron: int = -12
    rare_donor: int = -6
    stop: int = -1000  # a stop within an inserted stretch
    shortest: int = 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """[b1, b2, b3] the amino of a codon (4 is an unknown base), [amino, residue] their score; both 20 for what is unknown."""
    codon = np.full((5, 5, 5), UNKNOWN, np.int64)
    codon[:4, :4, :4] = np.array([AMINO.find(c) if c != "*" else STOP for c in CODONS]).reshape(4, 4, 4)
    table = np.zeros((22, 21), np.int32)
    table[:20, :20] = SCORES
    table[STOP] = NEVER
    return codon, table


CODON, SCORE = _tables()
_BASE = np.full(256, 4, np.int64)
for _k, _c in enumerate("ACGT"):
    _BASE[[ord(_c), ord(_c.lower())]] = _k
_BASE[[ord("U"), ord("u")]] = 3


class _Spliced:
    """The recursion over one stretch of bases.

    Of each residue: ``b`` ends in its codon or its omission, ``c`` may end in an
    intron after that, ``f`` in inserted codons after that; place j is behind j bases.
    """

    def __init__(self, protein: str, bases: str, costs: SpliceCosts):
        self.costs, self.n, self.m = costs, len(protein), len(bases)
        self.residues = [AMINO.find(c) if c in AMINO else UNKNOWN for c in protein.upper()]
        x = self.base = _BASE[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)]
        self.codon = np.full(self.m + 1, STOP, np.int64)
        self.codon[3:] = CODON[x[:-2], x[1:-1], x[2:]] if self.m >= 3 else []
        two = x[:-1] * 5 + x[1:] if self.m > 1 else x[:0]
        self.donor = np.flatnonzero((two == 2 * 5 + 3) | (two == 2 * 5 + 1))
        self.site = np.where(two[self.donor] == 2 * 5 + 3, 0, costs.rare_donor).astype(np.int32) + costs.intron
        self.acceptor = np.flatnonzero(two == 0 * 5 + 2) + 2
        upto = np.searchsorted(self.donor, self.acceptor - costs.shortest, "right")
        self.acceptor, self.upto = self.acceptor[upto > 0], upto[upto > 0] - 1
        # an intron within a codon: donors with enough bases before, acceptors with enough behind, donors by their codon's part
        self.phase = []
        for lead in (1, 2):
            part = np.where(self.donor >= lead, x[np.maximum(self.donor - lead, 0)] * (5 if lead == 2 else 1) + (x[np.maximum(self.donor - 1, 0)] if lead == 2 else 0), -1)
            kinds = np.unique(part[part >= 0])
            ok = self.acceptor + 3 - lead <= self.m
            to, last = self.acceptor[ok], self.upto[ok]
            first = kinds if lead == 1 else kinds // 5
            second = x[to][None, :] if lead == 1 else np.broadcast_to((kinds % 5)[:, None], (len(kinds), len(to)))
            third = x[np.minimum(to + 1, self.m - 1)] if lead == 1 else x[to]
            self.phase.append((lead, part[None, :] == kinds[:, None], to + 3 - lead, last, CODON[first[:, None], second, third[None, :]]))
        step = np.where(self.codon == STOP, costs.stop, costs.extend).astype(np.int64)
        self.width = -(-(self.m + 1) // 3) * 3
        self.step = np.concatenate((step, np.zeros(self.width - self.m - 1, np.int64))).reshape(-1, 3).cumsum(0)

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(self.m + 1, np.int32), np.full(self.m + 1, NEVER, np.int32)

    def row(self, i: int, f: np.ndarray, omitted: np.ndarray) -> tuple[np.ndarray, ...]:
        """b, c, f and omitted of residue i (from 0) after those of the one before."""
        costs, score = self.costs, SCORE[:, self.residues[i]]
        omitted = np.maximum(f + costs.open, omitted + costs.extend)
        b = omitted.copy()
        b[3:] = np.maximum(b[3:], f[:-3] + score[self.codon[3:]]) if self.m >= 3 else b[3:]
        if len(self.acceptor):
            for lead, of_kind, to, last, amino in self.phase:
                if not len(to) or not len(of_kind):
                    continue
                best = np.maximum.accumulate(np.where(of_kind, f[np.maximum(self.donor - lead, 0)] + self.site, NEVER), axis=1)
                value = (best[:, last] + score[amino]).max(0)
                b[to] = np.maximum(b[to], value)  # acceptors are distinct, so are the places
        c = b.copy()
        if len(self.acceptor):
            best = np.maximum.accumulate(b[self.donor] + self.site)
            c[self.acceptor] = np.maximum(c[self.acceptor], best[self.upto])
        wide = np.full(self.width, NEVER, np.int64)
        wide[: self.m + 1] = c
        wide = wide.reshape(-1, 3)
        best = np.maximum.accumulate(wide - self.step, axis=0)
        after = np.full_like(wide, NEVER)
        after[1:] = best[:-1] + self.step[1:] + (costs.open - costs.extend)
        f = np.maximum(c, after.reshape(-1)[: self.m + 1]).astype(np.int32)
        return np.maximum(b, NEVER), np.maximum(c, NEVER), np.maximum(f, NEVER), np.maximum(omitted, NEVER)

    def _cut(self, lead: int, i: int, j: int, value: int, f: np.ndarray) -> tuple[tuple[int, int, int], int] | None:
        """The codon of residue i that ends at j and has an intron after ``lead`` bases, with the place before it."""
        to = j - 3 + lead
        at = int(np.searchsorted(self.acceptor, to))
        if to <= 0 or at == len(self.acceptor) or self.acceptor[at] != to:
            return None
        k = self.donor[: self.upto[at] + 1]
        k, site = k[k >= lead], self.site[: self.upto[at] + 1][k >= lead]
        x = self.base
        second, third = (x[to], x[min(to + 1, self.m - 1)]) if lead == 1 else (x[k - 1], x[to])
        found = np.flatnonzero(f[k - lead] + site + SCORE[CODON[x[k - lead], second, third], self.residues[i]] == value)
        if not len(found):
            return None
        d = int(k[found[-1]])
        return ((d - 1, to, to + 1) if lead == 1 else (d - 2, d - 1, to)), d - lead

    def trace(self) -> tuple[int, list[tuple[int, int, int] | None], list[int]]:
        """The score, each residue's three bases (or None), and the exon that its middle one is in."""
        every = max(1, int(self.n**0.5))
        state, saved = self.start(), {}
        for i in range(self.n):
            if i % every == 0:
                saved[i] = state
            b, _, *state = self.row(i, *state)
        score, j = int(b.max()), int(b.argmax())
        codons: list[tuple[int, int, int] | None] = [None] * self.n
        exon, exons = 0, [0] * self.n
        rows, first, where, costs = [], self.n, "b", self.costs
        i = self.n - 1
        while i >= 0:
            if i < first:
                first = i // every * every
                state, rows = saved[first], [(None, None, *saved[first])]
                for k in range(first, i + 1):
                    rows.append(self.row(k, *rows[-1][2:]))
            b, c, f, omitted = rows[i - first + 1]
            before = rows[i - first][2]
            if where == "f":
                if f[j] != c[j]:
                    column, at = self.step[:, j % 3], np.arange(j // 3)
                    t = np.flatnonzero(c[at * 3 + j % 3] + column[j // 3] - column[at] + costs.open - costs.extend == f[j])[-1]
                    j = int(t) * 3 + j % 3
                where = "c"
            elif where == "c":
                if c[j] != b[j]:
                    at = int(np.searchsorted(self.acceptor, j))
                    k = self.donor[: self.upto[at] + 1]
                    j = int(k[np.flatnonzero(b[k] + self.site[: len(k)] == c[j])[-1]])
                    exon += 1
                where = "b"
            elif where == "o":
                where = "f" if omitted[j] == before[j] + costs.open else "o"
                exons[i], i = exon, i - 1
            elif j >= 3 and b[j] == before[j - 3] + SCORE[self.codon[j], self.residues[i]]:
                codons[i], exons[i] = (j - 3, j - 2, j - 1), exon
                i, j, where = i - 1, j - 3, "f"
            elif cut := self._cut(1, i, j, b[j], before) or self._cut(2, i, j, b[j], before):
                codons[i], to = cut
                middle_first = codons[i][1] - codons[i][0] == 1
                exons[i] = exon + middle_first
                exon += 1
                i, j, where = i - 1, to, "f"
            else:
                where = "o"
        return score, codons, [exon - e for e in exons]


def align_spliced(protein: str, bases: str, costs: SpliceCosts = SpliceCosts()) -> tuple[int, list[tuple[int, int, int] | None], list[int]]:
    """(score, the three bases of each residue or None, the exon of each residue, from 0) of the best spliced alignment."""
    if not protein or not bases:
        return 0, [None] * len(protein), [0] * len(protein)
    return _Spliced(protein, bases, costs).trace()


def spliced_residues(seqs: DataFrame, searches: DataFrame, chunks: DataFrame, size: int = 1 << 16, costs: SpliceCosts = SpliceCosts()) -> DataFrame:
    """seq_id, search, length, score, residue (from 0), exon, first, pos, last (bases of its codon in the joined ranges, from 1), same.

    ``searches``: seq_id, search, part, chr, a, b; the parts of a search are joined
    in their order, and a part with a > b is read on the other strand.
    """
    kind = dict(seqs.dtypes)["seq_id"]
    got = fetch(chunks, searches.select("seq_id", "search", "part", "chr", "a", "b"), size, ["seq_id", "search", "part"])

    def run(rows: list[tuple]) -> Iterator[tuple]:
        seq_id, search, residues = rows[0][0], rows[0][1], rows[0][4].upper()
        bases = "".join(r[3] for r in rows)
        score, codons, exons = align_spliced(residues, bases, costs)
        x = _BASE[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)]
        for k, (codon, exon) in enumerate(zip(codons, exons, strict=True)):
            if codon is not None:
                amino = int(CODON[tuple(x[list(codon)])])
                yield seq_id, search, len(residues), score, k, exon, codon[0] + 1, codon[1] + 1, codon[2] + 1, amino < 20 and AMINO[amino] == residues[k]

    rows = got.select("seq_id", "search", "part", "nucls").join(seqs.select("seq_id", "residues"), "seq_id")
    return map_groups(rows, ["seq_id", "search"], ["part"], run, f"seq_id {kind}, search long, length int, score long, residue int, exon int, first long, pos long, last long, same boolean")


def spliced_maps(seqs: DataFrame, searches: DataFrame, chunks: DataFrame, least_pct: float = 90.0, size: int = 1 << 16, costs: SpliceCosts = SpliceCosts()) -> DataFrame:
    """The searches in which the whole protein is found: seq_id, search, score, pct_id, chr (as a label), chimeric, rearranged, note, exons.

    An exon has a_start, a_end (residues from 0), chr, strand, n_start, n_end and the
    places of its codons' middle bases.  Every residue must have a codon,
    ``least_pct`` of them an equal one, and no exon over twelve bases a residue.
    A map over several chromosomes or strands, or out of order on one, is chimeric.
    """
    key = ["seq_id", "search"]
    found = kept(spliced_residues(seqs, searches, chunks, size, costs))
    whole = found.groupBy(*key).agg(F.count("*").alias("n"), F.first("length").alias("length"), F.first("score").alias("score"), percent_tenths(F.sum(F.col("same").cast("long")), F.count("*")).alias("pct_id"))
    whole = whole.filter((F.col("n") == F.col("length")) & (F.col("pct_id") >= least_pct)).drop("n", "length")
    # from places in the joined ranges back to the genome: the last range that begins at or before a place
    marks = running_offsets(searches.withColumn("len", F.abs(F.col("a") - F.col("b")) + 1), key, ["part"], "len")
    marks = marks.select(*key, F.col("offset").alias("pos"), F.struct("offset", "a", "chr", F.when(F.col("a") > F.col("b"), -1).otherwise(1).alias("strand")).alias("range"))
    points = found.join(whole.select(*key), key, "left_semi").select(*key, "residue", "exon", F.explode(F.array(*[F.struct(F.lit(k).alias("base"), F.col(c).alias("pos")) for k, c in enumerate(("first", "pos", "last"))])).alias("p")).select(*key, "residue", "exon", "p.*")
    placed = as_of(points, marks, key, "pos", ["range"])
    at = F.col("range.a") + F.col("range.strand") * (F.col("pos") - F.col("range.offset"))
    placed = placed.select(*key, "residue", "exon", "base", at.alias("at"), F.col("range.chr").alias("chr"), F.col("range.strand").alias("strand"))
    middle = F.when(F.col("base") == 1, F.struct("residue", "at"))
    first, last = F.struct("residue", "base"), F.struct("residue", "base")
    inside = placed.withColumn("own", F.max(F.when(F.col("base") == 1, F.struct("chr", "strand"))).over(Window.partitionBy(*key, "residue")))
    inside = inside.filter("own.chr = chr and own.strand = strand")
    exon = inside.groupBy(*key, "exon").agg(
        F.min("residue").alias("a_start"), F.max("residue").alias("a_end"), F.min_by("chr", first).alias("chr"), F.min_by("strand", first).alias("strand"), F.max_by("chr", last).alias("end_chr"), F.max_by("strand", last).alias("end_strand"),
        F.min_by("at", first).alias("n_start"), F.max_by("at", last).alias("n_end"), F.transform(F.array_sort(F.collect_list(middle)), lambda m: m["at"]).alias("centres"),
    )
    label, end_label = strand_label(F.col("chr"), F.col("strand")), strand_label(F.col("end_chr"), F.col("end_strand"))
    exon = exon.withColumn("label", F.when(label == end_label, label).otherwise(F.concat_ws("/", label, end_label)))
    exon = out_of_order(exon, [*key, "label"], ["exon"], "n_start", "n_end", "strand")
    runs = drop_repeats(exon, key, ["exon"], "label").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("exon", "label"))), lambda x: x["label"]).alias("labels"))
    own = exon.groupBy(*key).agg(F.bool_or("rearranged").alias("rearranged"), F.transform(F.array_sort(F.collect_list(F.struct("exon", F.struct("a_start", "a_end", "chr", "strand", "n_start", "n_end", "centres").alias("e")))), lambda x: x["e"]).alias("exons"))
    out = whole.join(own, key).join(runs, key).filter(~implausible(F.col("exons")))
    chimeric = (F.size("labels") > 1) | F.col("rearranged")
    said = F.when(chimeric, F.concat(F.lit("Chimeric:"), F.array_join("labels", "/"))).otherwise(F.get("labels", 0))
    return out.select(*key, "score", "pct_id", said.alias("chr"), chimeric.alias("chimeric"), "rearranged", mapping_notes(F.col("rearranged"), F.col("pct_id")).alias("note"), "exons")
