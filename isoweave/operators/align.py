"""Profile alignment with affine gaps and exon boundaries, and the tree-ordered merge of families."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.functions.bio import AMINO, SCORES
from isoweave.operators.grouped import dealt

_INDEX = {c: k for k, c in enumerate(AMINO)}
_TABLE = np.array(SCORES, np.float32)


@dataclass(frozen=True)
class GapCosts:
    open: float = -11.0
    extend: float = -1.0
    intron_base: float = -5.0
    intron_max: float = -200.0
    intron_mult: float = 2.0
    intron_intron: float = 0.0
    unspliced: bool = False


def framed(rows: list[str]) -> list[str]:
    """Rows with an exon boundary at both ends."""
    if rows and rows[0][:1] in ("/", "-") and rows[0][-1:] == "/":
        return rows
    return [f"/{r}/" for r in rows]


def profile(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column: letter shares among letters, whether it is a boundary, distance to the nearest boundary."""
    grid = np.array([list(r) for r in rows])
    boundary = (grid == "/").any(0)
    share = np.stack([(grid == c).sum(0) for c in AMINO], 1).astype(np.float32)
    other = np.array([(~np.isin(grid[:, k], ["-", "/"])).sum() for k in range(grid.shape[1])], np.float32)
    share /= np.maximum(other, 1)[:, None]
    at = np.flatnonzero(boundary)
    col = np.arange(grid.shape[1])
    near = np.abs(col[:, None] - at[None, :]).min(1) if len(at) else np.full(len(col), len(col))
    return share, boundary, near


def align(a: list[str], b: list[str], costs: GapCosts = GapCosts(), trace: bool = True) -> tuple[list[str], list[str], float]:
    """The best alignment of two framed profiles, as two sets of rows of one width, and its score; without ``trace`` the score alone.

    Match, insert (a gap in ``a``) and delete (a gap in ``b``) states; no insert
    follows a delete or the other way round.  Ties prefer insert, then delete,
    then match before a match, and extension before opening.  The matrices are
    filled along anti-diagonals; only the choices are kept for the trace.
    """
    (pa, ia, na), (pb, ib, nb) = profile(a), profile(b)
    n, m = len(ia), len(ib)
    sub = (pa @ _TABLE @ pb.T).astype(np.float32)
    sub[ia[:, None] ^ ib[None, :]] = -np.inf
    sub[ia[:, None] & ib[None, :]] = costs.intron_intron
    start = np.full((n, m), costs.open, np.float32)
    if not costs.unspliced:
        cost = lambda d: np.maximum(costs.intron_max, costs.intron_base * costs.intron_mult ** np.minimum(d, 60.0))
        start[ia[:, None] & ~ib[None, :]] = np.broadcast_to(cost(nb)[None, :], (n, m))[ia[:, None] & ~ib[None, :]]
        start[~ia[:, None] & ib[None, :]] = np.broadcast_to(cost(na)[:, None], (n, m))[~ia[:, None] & ib[None, :]]
    inf = np.float32(-np.inf)
    came = np.zeros((n, m) if trace else (0, 0), np.uint8)  # bits 0-1: before a match; bit 2: insert opened; bit 3: delete opened
    # the state of cell (i, d - i) stands at i; two diagonals back, one back, now
    empty = lambda: np.full(n, inf, np.float32)
    m2, i2, d2, m1, i1, d1 = (empty() for _ in range(6))
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(lo, hi + 1)
        j = d - i
        m0, i0, d0 = empty(), empty(), empty()
        if d == 0:
            m0[0] = costs.intron_intron
        else:
            inner = (i > 0) & (j > 0)
            up = np.maximum(i - 1, 0)
            prev = np.stack((m2[up], i2[up], d2[up]))
            best = np.maximum(np.maximum(prev[1], prev[2]), prev[0])
            m0[i] = np.where(inner, best + sub[i, j], inf)
            open_i, ext_i = m1[i] + start[i, j], i1[i] + np.float32(costs.extend)
            open_d, ext_d = m1[up] + start[i, j], d1[up] + np.float32(costs.extend)
            edge_i = np.where(j == 1, np.float32(costs.open), np.float32(costs.open) + (j - 1) * np.float32(costs.extend))
            edge_d = np.where(i == 1, np.float32(costs.open), np.float32(costs.open) + (i - 1) * np.float32(costs.extend))
            i0[i] = np.where(inner, np.maximum(open_i, ext_i), np.where(i == 0, edge_i, inf))
            d0[i] = np.where(inner, np.maximum(open_d, ext_d), np.where(j == 0, edge_d, inf))
            if trace:
                pick = np.where(prev[1] >= best, 1, np.where(prev[2] >= best, 2, 0))
                opened_i, opened_d = (ext_i < open_i) | (~inner & (j == 1)), (ext_d < open_d) | (~inner & (i == 1))
                came[i, j] = pick | (opened_i.astype(np.uint8) << 2) | (opened_d.astype(np.uint8) << 3)
        m2, i2, d2, m1, i1, d1 = m1, i1, d1, m0, i0, d0
    score = float(m1[n - 1])
    if not trace:
        return [], [], score
    steps, i, j, state = [], n - 1, m - 1, 0
    while True:
        steps.append(state)
        if i == 0 and j == 0:
            break
        mark = int(came[i, j])
        if state == 0:
            i, j, state = i - 1, j - 1, mark & 3
        elif state == 1:
            j, state = j - 1, 0 if mark & 4 else 1
        else:
            i, state = i - 1, 0 if mark & 8 else 2
    steps.reverse()
    took_a, took_b = np.array([s != 1 for s in steps]), np.array([s != 2 for s in steps])

    def spread(rows: list[str], took: np.ndarray) -> list[str]:
        out = []
        for r in rows:
            chars = np.full(len(took), "-")
            chars[took] = list(r)
            out.append("".join(chars))
        return out

    return spread(a, took_a), spread(b, took_b), score


def fold(sets: list[list[str]], costs: GapCosts = GapCosts()) -> list[str]:
    """One alignment of several, added in order."""
    out = framed(sets[0]) if sets else []
    for rows in sets[1:]:
        x, y, _ = align(out, framed(rows), costs)
        out = x + y
    return out


def finalize(rows: list[str]) -> list[str]:
    """Rows without boundary columns and without columns that are all gaps."""
    if not rows:
        return rows
    grid = np.array([list(r) for r in rows])
    keep = ~(grid == "/").any(0) & ~(grid == "-").all(0)
    return ["".join(r) for r in grid[:, keep]]


def merge_families(seqs: DataFrame, key: str, order: str, seq_id: str, aligned: str, *, final: bool = True, costs: GapCosts = GapCosts()) -> DataFrame:
    """Per family one alignment of its members (or of its species' alignments), in merge order.

    Rows of one ``order`` value are already aligned with each other; the values
    are folded from the smallest up.  Returns key, row_no, seq_id, aligned.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, seq_id])
        rows = fold([g[aligned].tolist() for _, g in pdf.groupby(order, sort=True)], costs)
        rows = finalize(rows) if final else rows
        return pd.DataFrame({key: pdf[key].to_numpy(), "row_no": np.arange(len(pdf)), seq_id: pdf[seq_id].to_numpy(), "aligned": rows})

    kinds = dict(seqs.dtypes)
    return dealt(seqs.select(key, order, seq_id, aligned), [key]).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, row_no long, {seq_id} {kinds[seq_id]}, aligned string")


def merge_by_steps(seqs: DataFrame, steps: list[tuple[str, str]], key: str, member: str, seq_id: str, aligned: str, *, costs: GapCosts = GapCosts()) -> DataFrame:
    """Per family one alignment of its members' alignments, merged pair by pair.

    ``steps`` are (into, from) names of members; a name then stands for all that
    was merged into it, or for what was to join it where a family lacks the member
    itself.  What the steps leave apart is joined in the order in which they name
    it, and members that no step names join at the end by name; a null member or alignment counts as an empty one.
    Returns key, row_no, seq_id, aligned.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([member, seq_id])
        held = {name: (g[seq_id].tolist(), framed(g[aligned].tolist())) for name, g in pdf.groupby(member, sort=True)}

        def join(into: str, source: str) -> None:
            if source not in held:
                return
            ids, rows = held.pop(source)
            if into in held:
                x, y, _ = align(held[into][1], rows, costs)
                ids, rows = held[into][0] + ids, x + y
            held[into] = (ids, rows)

        for into, source in steps:
            join(into, source)
        named = {name: k for k, name in enumerate(dict.fromkeys(x for step in steps for x in step))}
        first, *others = sorted(held, key=lambda name: (named.get(name, len(named)), name))
        for name in others:
            join(first, name)
        ids, rows = held[first]
        return pd.DataFrame({key: pdf[key].iloc[0], "row_no": np.arange(len(ids)), seq_id: ids, "aligned": finalize(rows)})

    kinds = dict(seqs.dtypes)
    known = seqs.select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in (member, aligned)], seq_id)
    return dealt(known, [key]).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, row_no long, {seq_id} {kinds[seq_id]}, aligned string")


def pair_scores(pairs: DataFrame, a: str, b: str, out: str = "score", costs: GapCosts = GapCosts(unspliced=True)) -> DataFrame:
    """The alignment score of two sequences per row."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([align(framed([p]), framed([q]), costs, trace=False)[2] for p, q in zip(x, y, strict=True)], dtype=float)

    return pairs.withColumn(out, score(a, b))
