"""Pair counts of many whole groups at once, for groups that fit one task.

Spark deals the scored rows out by group and sorts them; a task then reads its groups in blocks of
whole groups and counts their pairs with numpy. No row is copied per bit level or per query, so
what a task holds is its block of rows, and nothing but one row per group leaves it.

"Of the rows before mine in the order of human scores, how many have a judge score below mine" is
a count of ranks below a bound within a stretch of positions. :func:`weight_below` answers all of
them by going through the bits of the ranks once (a wavelet matrix). Counts are integers throughout;
each sum over pairs of a difference, such as h_b - h_a, is taken per row as its own score times the
pairs in which it is the upper less those in which it is the lower one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows after which a task counts the whole groups it has read.
BLOCK_ROWS = 200_000


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in blocks that end where a group ends; ``_first`` marks a group's first row."""
    held, rows, due = [], 0, BLOCK_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= due:
            block = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(block["_first"].to_numpy())[-1])
            if cut:
                yield block.slice(0, cut)
            held, rows = block.slice(cut).to_batches(), rows - cut
            due = rows + BLOCK_ROWS
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(values: np.ndarray, first: np.ndarray, last: np.ndarray, asked: np.ndarray, equal: bool = False) -> np.ndarray:
    """Per query the end of the values below ``asked`` (at most it, if ``equal``) in its sorted stretch first..last-1."""
    lo, hi = first.copy(), last.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = values[np.where(open_, mid, 0)]
        below = open_ & ((v <= asked) if equal else (v < asked))
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def running_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(x, dtype=np.int64)])


def weight_below(rank: np.ndarray, weight: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each (start, end, bound) the weight at positions start..end-1 whose rank is below the bound."""
    found = [np.zeros(len(s), np.int64) for s, _, _ in spans]
    top = max([int(rank.max(initial=0)), *[int(y.max(initial=0)) for _, _, y in spans]])
    for bit in reversed(range(top.bit_length())):
        one = (rank >> bit & 1).astype(bool)
        zeros, light = running_sum(~one), running_sum(np.where(one, 0, weight))
        for i, (s, e, y) in enumerate(spans):
            up, zs, ze = (y >> bit & 1).astype(bool), zeros[s], zeros[e]
            found[i] += np.where(up, light[e] - light[s], 0)
            spans[i] = (np.where(up, zeros[-1] + s - zs, zs), np.where(up, zeros[-1] + e - ze, ze), y)
        order = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        rank, weight = rank[order], weight[order]
    return found


def tied(values: np.ndarray, group: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: the number of each one's run of equal values (NaN equal to itself), and each run's weight."""
    same = (values[1:] == values[:-1]) | (np.isnan(values[1:]) & np.isnan(values[:-1]))
    start = np.concatenate([[True], ~same | (group[1:] != group[:-1])])
    return np.cumsum(start) - 1, np.add.reduceat(weight, np.flatnonzero(start))


def pair_statistics(starts: np.ndarray, h: np.ndarray, j: np.ndarray, w: np.ndarray, gap: float,
                    margin: float) -> dict[str, np.ndarray]:
    """Per group the statistics of :mod:`ranking`. Rows are sorted by group, ``h`` and ``j`` (NaN last);
    ``starts`` holds the groups' first rows and ``w`` the rows' weights."""
    count = len(h)
    ends = np.append(starts[1:], count)
    g = np.repeat(np.arange(len(starts)), ends - starts)
    first, last = starts[g], ends[g]
    per_group = lambda x: (c := running_sum(x))[ends] - c[starts]  # noqa: E731  exact
    real = lambda x: np.bincount(g, weights=x, minlength=len(starts))

    by_j = np.lexsort((j, g))
    rank = np.empty(count, np.int64)
    rank[by_j] = np.arange(count) - first
    js = j[by_j]
    hrun, hsum = tied(h, g, w)
    jrun, jsum = tied(js, g, w[by_j])
    # Per row its share of the tied pairs: w * (weight of the run - 1), twice the pairs.
    wj = np.empty(count, np.int64)
    wj[by_j] = jsum[jrun]
    h_ties, j_ties = per_group(w * (hsum[hrun] - 1)) // 2, per_group(w * (wj - 1)) // 2

    # A NaN human score makes no clear pair and a NaN judge score no concordant one.
    no_h, no_j = np.isnan(h), np.isnan(j)
    point, judged = np.where(no_h, 0, w), np.where(no_h | no_j, 0, w)
    points, judges = running_sum(point), running_sum(judged)
    h_end = ends[g] - per_group(no_h)[g]
    below_j = bounds(js, first, last, j) - first
    upto_j = bounds(js, first, last, j, equal=True) - first

    strict = bounds(h, first, h_end, h)                                     # rows with a smaller h end here
    under = bounds(h, first, h_end, h - gap)                                # rows of clear pairs below end here
    over = bounds(h - gap, first, h_end, h, equal=True)                     # rows of clear pairs above start here
    spans = [(first, under, below_j), (over, h_end, upto_j)]
    near = not np.array_equal(strict, under)
    if near:
        spans.append((first, strict, below_j))
    if margin > 0:
        spans += [(first, under, bounds(js, first, last, j - margin, equal=True) - first),
                  (over, h_end, bounds(js - margin, first, last, j) - first)]
    found = weight_below(rank, judged, spans)
    agree_below, agree_above = found[0], np.where(no_j, 0, judges[h_end] - judges[over] - found[1])
    clear_below, clear_above = points[under] - points[first], points[h_end] - points[over]

    def differences(x, weight, below, above):
        net = below - above
        return real(np.where((net == 0) | (weight == 0), 0.0, weight * np.where(weight == 0, 0.0, x) * net))
    concordant = per_group(judged * (found[2] if near else agree_below))
    lower = per_group(point * (points[strict] - points[first]))
    # Pairs with unequal h and equal j: those tied on j less those tied on both.
    brun, bsum = tied(j, hrun, w)
    tied_both = per_group(w * (bsum[brun] - 1)) // 2
    n = per_group(w)
    out = {"n": n, "has_nan": per_group(no_h | no_j) > 0, "n_h_ties": h_ties, "n_j_ties": j_ties,
           "s": 2 * concordant - lower + j_ties - tied_both, "clear_pairs": per_group(point * clear_below),
           "mismatch_loss": differences(h, point, clear_below - agree_below, clear_above - agree_above)}
    # Spearman: average ranks, centred so that the sums stay well conditioned.
    weights = running_sum(w)
    hs = np.flatnonzero(np.diff(hrun, prepend=-1))
    jstart = np.flatnonzero(np.diff(jrun, prepend=-1))
    wjs = running_sum(w[by_j])
    mid = (n[g] + 1) / 2
    ch = weights[hs[hrun]] - weights[first] + (hsum[hrun] + 1) / 2 - mid
    cj = np.empty(count)
    cj[by_j] = wjs[jstart[jrun]] - wjs[first] + (jsum[jrun] + 1) / 2 - mid
    out |= {"sxy": real(w * ch * cj), "sxx": real(w * ch * ch), "syy": real(w * cj * cj)}
    short_below, short_above = (agree_below - found[-2], found[-1] - found[1]) if margin > 0 else (np.zeros(count, np.int64),) * 2
    # A clear pair the judge orders alike by less than the margin costs margin - (j_b - j_a).
    out["penalty"] = margin * per_group(judged * short_below) - differences(j, judged, short_below, short_above)
    return out


def grouped_pairs(gap: float, margin: float, names: list[str]):
    """The function for ``mapInArrow``: rows (keys, _h, _j, _w, _first) sorted by key and _h in, one row per group out."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in whole_groups(batches):
            starts = np.flatnonzero(block["_first"].to_numpy())
            col = lambda c: block[c].to_numpy()
            stats = pair_statistics(starts, col("_h"), col("_j"), col("_w").astype(np.int64), gap, margin)
            keys = block.drop_columns(["_h", "_j", "_w", "_first"]).take(pa.array(starts))
            out = pa.Table.from_arrays([*keys.columns, *[pa.array(stats[c]) for c in names]], names=[*keys.column_names, *names])
            yield from out.combine_chunks().to_batches()
    return count
