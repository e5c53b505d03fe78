"""Agreement of two partitions: contingency table, ARI, NMI, AMI, matched Jaccard, retention."""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.session import cut

def contingency(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by.., a, b, n)`` of ``(by.., node_id, a)`` and ``(by.., node_id, b)``."""
    return a.join(b, [*(by or []), "node_id"]).groupBy(*(by or []), "a", "b").agg(F.count("*").alias("n"))


def _pairs(c):
    return c * (c - 1) / 2


def scores(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by.., n, ari, nmi, nmi_geometric)`` of contingency tables.

    One grouping of the table gives cells, both margins and the total. No pairs: 1. Both partitions without entropy: 1.
    """
    by = by or []
    sets = table.withColumn("n", F.col("n").cast("double"))
    grouped = sets.cube("a", "b") if not by else None
    if by:
        rows = sets.groupingSets([[*by, "a", "b"], [*by, "a"], [*by, "b"], by], *by, "a", "b")
    else:
        rows = grouped
    marg = rows.agg(F.sum("n").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    total = marg.groupBy(*by).agg(
        F.sum(F.when((F.col("ga") == 1) & (F.col("gb") == 1), F.col("n"))).alias("n"),
        F.sum(F.when((F.col("ga") == 0) & (F.col("gb") == 0), _pairs(F.col("n")))).alias("cells"),
        F.sum(F.when((F.col("ga") == 0) & (F.col("gb") == 1), _pairs(F.col("n")))).alias("pa"),
        F.sum(F.when((F.col("ga") == 1) & (F.col("gb") == 0), _pairs(F.col("n")))).alias("pb"),
        F.sum(F.when((F.col("ga") == 0) & (F.col("gb") == 0), F.col("n") * F.log("n"))).alias("lc"),
        F.sum(F.when((F.col("ga") == 0) & (F.col("gb") == 1), F.col("n") * F.log("n"))).alias("la"),
        F.sum(F.when((F.col("ga") == 1) & (F.col("gb") == 0), F.col("n") * F.log("n"))).alias("lb"),
    )
    all_ = _pairs(F.col("n"))
    expected = F.col("pa") * F.col("pb") / all_
    most = (F.col("pa") + F.col("pb")) / 2
    ari = F.when(all_ <= 0, F.lit(1.0)).when(most == expected, F.lit(1.0)).otherwise((F.col("cells") - expected) / (most - expected))
    ln = F.log("n")
    ha, hb = ln - F.col("la") / F.col("n"), ln - F.col("lb") / F.col("n")
    mi = ln + (F.col("lc") - F.col("la") - F.col("lb")) / F.col("n")
    tiny = 1e-12
    nmi = F.when((ha < tiny) & (hb < tiny), F.lit(1.0)).when((ha + hb) < tiny, F.lit(0.0)).otherwise(2 * mi / (ha + hb))
    geo = F.when((ha < tiny) & (hb < tiny), F.lit(1.0)).when((ha < tiny) | (hb < tiny), F.lit(0.0)).otherwise(mi / F.sqrt(ha * hb))
    return total.select(*by, F.col("n").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"), geo.alias("nmi_geometric"))


_TABLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """From a table, beyond it by Stirling's series, whose next term is below the precision of a double there."""
    big = np.maximum(k, len(_TABLE)).astype(float)
    series = (big + 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(k < len(_TABLE), _TABLE[np.minimum(k, len(_TABLE) - 1)], series)


def expected_information(n: int, x: np.ndarray, y: np.ndarray, times: np.ndarray, terms: int = 1 << 20) -> float:
    """Exact expectation of the mutual information over pairs of cluster sizes, each counted ``times``.

    Overlaps whose probability is no number above 0 in double precision add nothing and aren't visited: with mean m, those below m - sqrt(2 m c) and above
    the k of k ln(k / m) - k + m = c, where exp(-c) is 0 (Chernoff's bounds).
    """
    c = 760.0
    m = x * (y / n)
    top = m + c
    for _ in range(60):  # Newton's steps from above on a convex function
        top = top - (top * np.log(top / m) - top + m - c) / np.log(top / m)
    low = np.maximum(np.maximum(1, x + y - n), np.floor(m - np.sqrt(2 * m * c)).astype(np.int64))
    high = np.minimum(np.minimum(x, y), np.ceil(top).astype(np.int64) + 1)
    count = np.maximum(high - low + 1, 0)
    fixed = log_factorial(x) + log_factorial(y) + log_factorial(n - x) + log_factorial(n - y) - log_factorial(np.array([n]))
    total, begin, upto = 0.0, 0, np.cumsum(count)
    while begin < len(x):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + terms, side="right")))
        r = np.repeat(np.arange(begin, end), count[begin:end])
        k = low[r] + np.arange(len(r)) - (upto[r] - count[r] - (upto[begin - 1] if begin else 0))
        a, b = x[r], y[r]
        logp = fixed[r] - log_factorial(k) - log_factorial(a - k) - log_factorial(b - k) - log_factorial(n - a - b + k)
        total += float((times[r] * (k / n) * np.log((k / a) * (n / b)) * np.exp(logp)).sum())
        begin = end
    return total


def ami_of(table: np.ndarray) -> float:
    """Adjusted mutual information with the exact expectation, normalised by the larger entropy."""
    n = int(table.sum())
    if n == 0:
        return float("nan")
    a, b = table.sum(1).astype(np.int64), table.sum(0).astype(np.int64)
    a, b = a[a > 0], b[b > 0]
    cells = table[table > 0]
    plain = lambda c: float((c * np.log(c)).sum()) / n
    ha, hb = np.log(n) - plain(a), np.log(n) - plain(b)
    mi = np.log(n) + plain(cells) - plain(a) - plain(b)
    (xs, xt), (ys, yt) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    x, y = (v.ravel() for v in np.meshgrid(xs, ys, indexing="ij"))
    return _adjusted(mi, max(ha, hb), expected_information(n, x, y, np.outer(xt, yt).ravel()))


def _adjusted(mi: float, most: float, expect: float) -> float:
    return 1.0 if abs(most - expect) < 1e-12 else (mi - expect) / (most - expect)


def ami(table: DataFrame, by: str) -> DataFrame:
    """``(by, ami)``: margins are counted by size, of which there are at most sqrt(2 n), and a task gets the pairs of some sizes of a with all sizes of b."""
    t = cut(table.select(by, "a", "b", "n"))
    kind = t.schema[by].dataType.simpleString()
    plain = F.sum(F.col("n") * F.log("n"))
    of = lambda c, name: t.groupBy(by, c).agg(F.sum("n").alias(name))
    a, b = cut(of("a", "x")), cut(of("b", "y"))
    sums = t.groupBy(by).agg(F.sum("n").alias("total"), plain.alias("lc"))
    for side, size in ((a, "x"), (b, "y")):
        sums = sums.join(side.withColumnRenamed(size, "n").groupBy(by).agg(plain.alias(f"l{size}")), by)
    sums = cut(sums)
    xs, ys = a.groupBy(by, "x").agg(F.count("*").alias("tx")), b.groupBy(by, "y").agg(F.count("*").alias("ty"))
    pairs = xs.join(sums.select(by, "total"), by).join(ys, by).select(by, "total", "x", "y", (F.col("tx") * F.col("ty")).alias("times"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, times = (pdf[c].to_numpy(dtype=np.int64) for c in ("x", "y", "times"))
        return pd.DataFrame({by: [key[0]], "part": [expected_information(int(pdf["total"].iloc[0]), x, y, times)]})

    expected = pairs.withColumn("bin", F.pmod(F.xxhash64("x"), F.lit(64))).groupBy(by, "bin").applyInPandas(run, f"{by} {kind}, part double").groupBy(by).agg(F.sum("part").alias("expected"))
    ln, n = F.log("total"), F.col("total")
    most = ln - F.least("lx", "ly") / n - F.col("expected")
    mi = ln + (F.col("lc") - F.col("lx") - F.col("ly")) / n - F.col("expected")
    return sums.join(expected, by).select(by, F.when(F.abs(most) < 1e-12, 1.0).otherwise(mi / most).alias("ami"))


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest total weight; pairs without weight are left out."""
    a, b = np.nonzero(weight > 0)
    return matching(a, b, weight[a, b])


def matching(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), each once at most, with the largest total of positive weights, of those listed.

    Shortest augmenting paths over the listed pairs only; a row may stay alone at weight 0. ``u`` and ``v`` keep u + v >= weight, with equality for what is paired,
    and paths follow the slack u + v - weight, which is 0 for most rows at once.
    """
    rows, ra = np.unique(a, return_inverse=True)
    cols, rb = np.unique(b, return_inverse=True)
    order = np.lexsort((rb, ra))
    ra, rb, weight = ra[order], rb[order], weight[order]
    bounds = np.searchsorted(ra, np.arange(len(rows) + 1)).tolist()
    to, w = rb.tolist(), weight.tolist()
    u, v = np.maximum.reduceat(weight, bounds[:-1]).tolist() if len(rows) else [], [0.0] * len(cols)
    mate_row, mate_col = [-1] * len(rows), [-1] * len(cols)  # a row's column, a column's row
    for start in range(len(rows)):
        # The slack of a column on the best path to it, and that of ending a path by leaving its last row alone (u of that row falls to 0).
        dist, back, done, heap = {}, {}, [], []
        row, at, stop, goal = start, 0.0, u[start], -1 - start
        passed = [(start, 0.0)]
        while True:
            for e in range(bounds[row], bounds[row + 1]):
                d = at + max(0.0, u[row] + v[to[e]] - w[e])
                if d < stop and d < dist.get(to[e], np.inf):
                    dist[to[e]], back[to[e]] = d, row
                    heappush(heap, (d, to[e]))
            while heap and heap[0][0] > dist[heap[0][1]]:
                heappop(heap)
            if not heap or heap[0][0] >= stop:
                break
            at, col = heappop(heap)
            if mate_col[col] < 0:
                stop, goal = at, col
                break
            done.append((col, at))
            row = mate_col[col]
            passed.append((row, at))
            if at + u[row] < stop:
                stop, goal = at + u[row], -1 - row
        for r, d in passed:
            u[r] -= max(0.0, stop - d)
        for c, d in done:
            v[c] += max(0.0, stop - d)
        if goal < 0:  # this row gives its column up and stays alone
            row = -1 - goal
            col, mate_row[row] = mate_row[row], -1
            if row == start:
                continue
        else:
            col = goal
        while True:
            row = back[col]
            mate_col[col], mate_row[row], col = row, col, mate_row[row]
            if row == start:
                break
    return [(int(rows[r]), int(cols[c])) for r, c in enumerate(mate_row) if c >= 0]


def matched_jaccard(table: DataFrame, by: str, least: int = 1) -> DataFrame:
    """``(by, a, b, jaccard, size)``: clusters of a matched one to one with those of b for the largest total Jaccard; unmatched: b null, 0."""
    kind, ka, kb = (table.schema[c].dataType.simpleString() for c in (by, "a", "b"))

    def run(key, pdf):
        (ra, a), (rb, b), n = np.unique(pdf["a"], return_inverse=True), np.unique(pdf["b"], return_inverse=True), pdf["n"].to_numpy(dtype=float)
        sa, sb = np.bincount(a, n), np.bincount(b, n)
        j, keep = n / (sa[a] + sb[b] - n), sa >= least
        use = keep[a]
        pick = dict(matching(a[use], b[use], j[use]))
        at = {(r, c): w for r, c, w in zip(a[use].tolist(), b[use].tolist(), j[use].tolist(), strict=True)}
        rows = [(key[0], ra[r], rb[pick[r]] if r in pick else None, at[r, pick[r]] if r in pick else 0.0, int(sa[r])) for r in np.flatnonzero(keep).tolist()]
        return pd.DataFrame(rows, columns=[by, "a", "b", "jaccard", "size"]).astype({"b": "Int64"} if kb in ("int", "bigint") else {})

    return table.groupBy(by).applyInPandas(run, f"{by} {kind}, a {ka}, b {kb}, jaccard double, size long")


def jaccard_class(j):
    """stable from 0.85, doubtful from 0.6."""
    return F.when(j >= 0.85, "stable").when(j >= 0.6, "doubtful").otherwise("unstable")


def retention(a: DataFrame, b: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``(by.., node_id, retention)``: share of a node's companions in a that are its companions in b; null without companions."""
    na = F.sum("n").over(Window.partitionBy(*by, "a"))
    t = table.withColumn("na", na)
    r = F.when(F.col("na") > 1, (F.col("n") - 1) / (F.col("na") - 1))
    return a.join(b, [*by, "node_id"]).join(t, [*by, "a", "b"]).select(*by, "node_id", r.alias("retention"))


def verdict(ari):
    return F.when(ari > 0.85, "strong").when(ari > 0.5, "moderate").otherwise("substantial")


def log_gamma(x: float) -> float:
    return math.lgamma(x)
