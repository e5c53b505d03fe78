"""Hierarchical density clustering of millions of positions.

1. Mutual-reachability neighbour graph: the ``neighbours`` nearest rows of each row (``neighbours.nearest``); an edge weighs as much as the largest
   of its length and its ends' core distances (to the ``min_samples``-th neighbour).
2. Minimum spanning tree by Borůvka's steps, distributed over the blocks of the k-d tree: within a block every component joins along its
   lightest edge until that edge leaves the block; then eight blocks at a time are merged, of which only components and edges
   that are still open remain.
3. Cores: the tree's edges are taken from light to heavy within the same blocks. A component that reaches ``min_size`` rows is a core; a smaller one
   that meets it falls out of whatever cluster that core is in at this weight, so it's settled with the core and the weight, in whatever order larger components
   merge. Only small components that an edge to another block may join first wait for the merged blocks. What is left of the tree is an edge
   for each core but one: the skeleton, of at most 1 / ``min_size`` of the rows (1 / 70 measured).
4. Condensed hierarchy: each component of the skeleton is merged in a task of its own, which gives the clusters and, for each core, the chain of
   clusters it is in by level (the smaller side changes chains, so a core does so log2(cores) times at most). Rows are counted by core and level before they meet the chains.
   Levels are logarithms of density (-ln distance), so that groups of different density compare, in whole steps of 1 / 4096; sums are exact whatever the order.
5. Selection by stability: a cluster is chosen if its stability is at least that of its best descendants together and no chosen one
   contains it. A chosen cluster must persist: between its birth and the loss of half of its members there is a gap
   of at least ``min_gap`` (natural logarithm of distance) in which it loses nobody; what left it before the widest gap is scattered.
6. Exemplars are the members that stay longest, ties by the smaller identifier.

Components that no edge joins are born at the heaviest edge of the graph. Rows beyond the k + 1 smallest identifiers of one position take
the cluster of that position. Defined results: unusable vectors as in ``neighbours``; fewer than ``min_size`` rows, or an empty table, give no cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.neighbours import Neighbours, nearest
from papyrine.operators.skew import join_hot
from papyrine.operators.graph import connected_components
from papyrine.session import cut

_HALF = "kind int, u long, v long, w double, c long, lu long, lv long"
_STEPS = 4096  # levels in a unit of the natural logarithm


def reach_edges(found: Neighbours, min_samples: int) -> DataFrame:
    """Records ``(u, v, w, c, lu, lv)`` of the mutual-reachability graph, c being u; an edge within a block once, one between blocks in both directions."""
    k = found.k
    p = found.lists.select("leaf", F.arrays_zip("d2", "nid").alias("p"))
    each = p.select("leaf", "p", F.explode(F.expr("filter(p, e -> e.d2 = 0)")).alias("s"))
    each = each.select("leaf", F.col("s.nid").alias("u"), F.expr(f"slice(filter(p, e -> e.nid <> s.nid), 1, {k})").alias("p")).filter(F.size("p") > 0)
    each = each.withColumn("core", F.sqrt(F.element_at("p", F.least(F.lit(min_samples), F.size("p")))["d2"])).withColumn("last", F.element_at("p", -1)["d2"])
    out = each.select(F.col("leaf").alias("lu"), "u", "core", F.explode("p").alias("e")).select("lu", "u", "core", F.col("e.nid").alias("v"), F.col("e.d2").alias("d2"))
    far = each.select(F.col("u").alias("v"), F.col("core").alias("core_v"), F.col("leaf").alias("lv"), "last")
    # If v is sure to have u among its nearest too, the edge comes once, from the smaller of them.
    edges = out.join(far, "v").filter(~((F.col("d2") < F.col("last")) & (F.col("u") > F.col("v")))).select("u", "v", F.greatest("core", "core_v", F.sqrt("d2")).alias("w"), "lu", "lv")
    ends = F.array(F.struct("u", "v", "lu", "lv"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("lv").alias("lu"), F.col("lu").alias("lv")))
    halves = edges.select("w", F.explode(F.when(F.col("lu") == F.col("lv"), F.slice(ends, 1, 1)).otherwise(ends)).alias("e"))
    return halves.select("e.u", "e.v", "w", F.col("e.u").alias("c"), "e.lu", "e.lv")


def _boruvka(shift: int, single: bool):
    """Borůvka's steps inside one block: kind 0 are edges of the tree, kind 1 what is still open; ``single``: edges within a block come in one direction."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, w, c, lu, lv = (pdf[x].to_numpy() for x in ("u", "v", "w", "c", "lu", "lv"))
        if single:
            own = lu == lv
            u, v, w, c, lu, lv = (np.concatenate([x, y[own]]) for x, y in ((u, v), (v, u), (w, w), (c, v), (lu, lv), (lv, lu)))
        a, b = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((u, b, a, w))
        u, v, w, c, lu, lv, a, b = (x[order] for x in (u, v, w, c, lu, lv, a, b))
        keep = np.ones(len(u), dtype=bool)
        keep[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, w, c, lu, lv, a, b = (x[keep] for x in (u, v, w, c, lu, lv, a, b))
        rank = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])).astype(np.int64)
        comps, cu = np.unique(c, return_inverse=True)
        local = (lv >> shift) == (lu >> shift)
        ends, first = np.unique(u, return_index=True)
        cv = np.full(len(u), -1)
        cv[local] = cu[first[np.searchsorted(ends, v[local])]]
        label = np.arange(len(comps))  # of each component of the input
        alive = (cv < 0) | (cu != cv)
        e = np.flatnonzero(alive)
        tree = []
        while len(e):
            x, y = label[cu[e]], np.where(cv[e] >= 0, label[np.maximum(cv[e], 0)], -1)
            inter = x != y
            e, x, y = e[inter], x[inter], y[inter]
            who, at = np.unique(x, return_index=True)  # e ascends by rank: the first is the lightest
            hook = y[at] >= 0
            if not hook.any():
                break
            parent = np.arange(len(comps))
            parent[who[hook]] = y[at][hook]
            both = parent[parent] == np.arange(len(comps))
            root = both & (np.arange(len(comps)) < parent)
            parent[root] = np.flatnonzero(root)
            tree.append(np.unique(rank[e[at[hook]]]))
            while True:
                nxt = parent[parent]
                if (nxt == parent).all():
                    break
                parent = nxt
            label = parent[label]
        reps = np.full(len(comps), np.iinfo(np.int64).max)
        np.minimum.at(reps, label, comps)
        out = []
        if tree:
            at = np.searchsorted(rank, np.unique(np.concatenate(tree)))
            turned = u[at] != a[at]
            out.append(pd.DataFrame({"kind": 0, "u": a[at], "v": b[at], "w": w[at], "c": 0, "lu": np.where(turned, lv[at], lu[at]), "lv": np.where(turned, lu[at], lv[at])}))
        if len(e):  # of parallel edges between two components of the block one is enough
            x, y = label[cu[e]], np.where(cv[e] >= 0, label[np.maximum(cv[e], 0)], -1)
            key = np.where(y >= 0, x * len(comps) + y, -1 - e)
            e = np.sort(e[np.unique(key, return_index=True)[1]])
            out.append(pd.DataFrame({"kind": 1, "u": u[e], "v": v[e], "w": w[e], "c": reps[label[cu[e]]], "lu": lu[e], "lv": lv[e]}))
        return pd.concat(out) if out else pd.DataFrame({x: pd.Series(dtype="int64") for x in ("kind", "u", "v", "w", "c", "lu", "lv")}).astype({"w": float})

    return run


def spanning_forest(half: DataFrame, depth: int) -> DataFrame:
    """``(u, v, w, lu, lv)``: the minimum spanning forest of the graph given by half-records, with the blocks of the ends."""
    tree, open_, shift = None, half, 0
    while True:
        step = cut(open_.groupBy(F.expr(f"shiftright(lu, {shift})")).applyInPandas(_boruvka(shift, tree is None), _HALF))
        part = step.filter("kind = 0").select("u", "v", "w", "lu", "lv")
        tree = part if tree is None else tree.unionByName(part)
        if shift >= depth:
            return tree
        open_ = step.filter("kind = 1").select("u", "v", "w", "c", "lu", "lv")
        shift = min(depth, shift + 3)


_OPEN = "kind int, u long, v long, w double, e long, big boolean, lu long, lv long, members array<long>"


def _settle(shift: int, min_size: int):
    """Merges components of fewer than ``min_size`` rows inside one block, edges from light to heavy.

    Rows in and out, by kind: 1 half an edge that is open, ``e`` being what its end ``u`` is in, a core (``big``) or a small component; 2 such a component and its
    members; rows out besides: 3 an edge between two cores; 4 a row ``u`` that goes with core ``e`` from weight ``w`` on.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        half = pdf[pdf["kind"] == 1]
        u, v, w, e, lu, lv = (half[x].to_numpy() for x in ("u", "v", "w", "e", "lu", "lv"))
        big = half["big"].to_numpy().astype(bool)
        order = np.lexsort((u, np.maximum(u, v), np.minimum(u, v), w))  # both halves of an edge inside the block lie side by side
        u, v, w, e, lu, lv, big = (x[order] for x in (u, v, w, e, lu, lv, big))
        reps, at = np.unique(e, return_inverse=True)
        core: list = [None] * len(reps)  # of each end: the core it is with
        for k in np.unique(at[big]).tolist():
            core[k] = int(reps[k])
        held = [[int(r)] for r in reps]
        states = pdf[pdf["kind"] == 2]
        for c, m in zip(np.searchsorted(reps, states["e"].to_numpy(dtype=np.int64)).tolist(), states["members"], strict=True):
            held[c] = [int(x) for x in m]
        parent, ends, waits = list(range(len(reps))), [[k] for k in range(len(reps))], [False] * len(reps)

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        ids, cores, weights, xs, ys, zs, left = [], [], [], [], [], [], []

        def join(i: int, c: int, weight: float) -> None:
            ids.extend(held[i])
            cores.extend([c] * len(held[i]))
            weights.extend([weight] * len(held[i]))
            for k in ends[i]:
                core[k] = c
            held[i] = None

        inside, ks, ws = ((lv >> shift) == (lu >> shift)).tolist(), at.tolist(), w.tolist()
        n = 0
        while n < len(ks):
            p = ks[n]
            if not inside[n]:
                if core[p] is None:
                    waits[find(p)] = True
                left.append(n)
                n += 1
                continue
            q, weight = ks[n + 1], ws[n]
            cp, cq = core[p], core[q]
            if cp is not None and cq is not None:
                xs.append(cp)
                ys.append(cq)
                zs.append(weight)
            else:
                i, j = find(p) if cp is None else -1, find(q) if cq is None else -1
                if (i >= 0 and waits[i]) or (j >= 0 and waits[j]):
                    if i >= 0:
                        waits[i] = True
                    if j >= 0:
                        waits[j] = True
                    left += [n, n + 1]
                elif i < 0:
                    join(j, cp, weight)
                elif j < 0:
                    join(i, cq, weight)
                else:
                    if len(held[i]) < len(held[j]):
                        i, j = j, i
                    parent[j] = i
                    held[i] += held[j]
                    ends[i] += ends[j]
                    held[j] = None
                    if len(held[i]) >= min_size:
                        join(i, min(held[i]), weight)
            n += 2
        out = [pd.DataFrame({"kind": 3, "u": xs, "v": ys, "w": zs}), pd.DataFrame({"kind": 4, "u": ids, "e": cores, "w": weights})]
        if left:
            k = at[left]
            known = np.array([core[x] is not None for x in k.tolist()])
            small = {find(x) for x in k[~known].tolist()}
            name = {i: min(held[i]) for i in small}
            now = [core[x] if c else name[find(x)] for x, c in zip(k.tolist(), known.tolist(), strict=True)]
            out.append(pd.DataFrame({"kind": 1, "u": u[left], "v": v[left], "w": w[left], "e": now, "big": known, "lu": lu[left], "lv": lv[left]}))
            block = int(lu[0])
            out.append(pd.DataFrame({"kind": 2, "e": [name[i] for i in small], "lu": block, "members": [held[i] for i in small]}))
        # No nulls in whole numbers: pandas would read them back as fractions.
        kinds = {"kind": "int64", "u": "int64", "v": "int64", "w": float, "e": "int64", "big": bool, "lu": "int64", "lv": "int64", "members": object}
        for o in out:
            for c in kinds:
                if c not in o:
                    o[c] = pd.Series([None] * len(o), dtype=object, index=o.index) if c == "members" else 0
        return pd.concat([o[list(kinds)].astype(kinds) for o in out])

    return run


def cores(tree: DataFrame, depth: int, min_size: int) -> tuple[DataFrame, DataFrame]:
    """``(id, core, w)``: the rows with their core and the weight from which on they are with it; ``(u, v, w)``: the skeleton between the cores."""
    one = tree.select(F.lit(1).alias("kind"), "u", "v", "w", F.col("u").alias("e"), F.lit(False).alias("big"), "lu", "lv", F.lit(None).cast("array<long>").alias("members"))
    two = tree.select(F.lit(1).alias("kind"), F.col("v").alias("u"), F.col("u").alias("v"), "w", F.col("v").alias("e"), F.lit(False).alias("big"), F.col("lv").alias("lu"), F.col("lu").alias("lv"), F.lit(None).cast("array<long>").alias("members"))
    open_, rows, skeleton, shift = one.unionByName(two), None, None, 0
    while True:
        step = cut(open_.groupBy(F.expr(f"shiftright(lu, {shift})")).applyInPandas(_settle(shift, min_size), _OPEN))
        r, k = step.filter("kind = 4").select(F.col("u").alias("id"), F.col("e").alias("core"), "w"), step.filter("kind = 3").select("u", "v", "w")
        rows, skeleton = (r, k) if rows is None else (rows.unionByName(r), skeleton.unionByName(k))
        if shift >= depth:
            return rows, skeleton
        open_ = step.filter("kind in (1, 2)")
        shift = min(depth, shift + 3)


_CHAINS = "kind int, cluster long, up long, chain long, born int, died int, core long, leaf boolean"


def _chains(pdf: pd.DataFrame) -> pd.DataFrame:
    """The clusters of one component of the skeleton (``u = v``: a core and the level at which it came about; else an edge).

    Rows out: 0 a cluster, the one above it, the chain of clusters it is in, the levels at which it came about (the higher) and went
    into the one above (the lower); 1 a core's stay with a cluster of its own (``leaf``) or a chain, at levels from ``born`` down to above ``died``.
    """
    first = pdf[pdf["u"] == pdf["v"]].sort_values("u")
    edges = pdf[pdf["u"] != pdf["v"]].sort_values(["w", "u", "v"], kind="stable")
    names, born = first["u"].to_numpy(), first["level"].tolist()
    n = len(names)
    parent, held, on, top = list(range(n)), [[i] for i in range(n)], list(range(n)), list(range(n))
    since = [np.iinfo(np.int32).max] * n  # of each core
    chain, died, up = list(range(n)), [0] * n, [-1] * n  # of each cluster; the first n are leaves
    stays = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def leave(c: int, level: int, to: int) -> None:
        if since[c] > level:
            stays.append((c, on[c], since[c] > 2**30, since[c], level))
        on[c], since[c] = to, level

    ends = zip(np.searchsorted(names, edges["u"].to_numpy()).tolist(), np.searchsorted(names, edges["v"].to_numpy()).tolist(), edges["level"].tolist(), strict=True)
    for count, (a, b, level) in enumerate(ends):
        i, j = find(a), find(b)
        if len(held[i]) < len(held[j]):
            i, j = j, i
        path = on[held[i][0]]
        if len(held[i]) == 1:
            leave(held[i][0], level, path)
        for c in held[j]:
            leave(c, level, path)
        new = n + count
        for old in (top[i], top[j]):
            died[old], up[old] = level, new
        born.append(level)
        chain.append(path)
        died.append(0)
        up.append(-1)
        parent[j], top[i] = i, new
        held[i] += held[j]
        held[j] = None
    for c in range(n):
        leave(c, np.iinfo(np.int32).min, 0)
    clusters = pd.DataFrame({"kind": 0, "cluster": np.arange(len(born)), "up": up, "chain": chain, "born": born, "died": died, "core": np.concatenate([names, np.zeros(len(born) - n, dtype=np.int64)]), "leaf": np.arange(len(born)) < n})
    s = pd.DataFrame(stays, columns=["core", "chain", "leaf", "born", "died"]).assign(kind=1, cluster=0, up=0)
    s["core"] = names[s["core"].to_numpy(dtype=np.int64)]
    return pd.concat([clusters, s])[[x.split()[0] for x in _CHAINS.split(", ")]]


_CHOSEN = "core long, top long, birth int, death int, leaf boolean, size long"


def _choose(root: int):
    """Chosen clusters from the clusters of a component (kind 0) and the rows counted by chain and level, or by cluster of its own (kind 2)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf[pdf["kind"] == 0].sort_values("cluster")
        up = c["up"].to_numpy(dtype=np.int64)
        born, died = c["born"].to_numpy(dtype=np.int64), c["died"].to_numpy(dtype=np.int64)
        died = np.where(up < 0, np.minimum(root, born), died)
        lost, levels = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        counts = pdf[pdf["kind"] == 2]
        own = counts[counts["leaf"]]
        at = own["chain"].to_numpy(dtype=np.int64)  # a leaf is numbered like its core's chain
        lost[at], levels[at] = own["n"].to_numpy(dtype=np.int64), own["sum"].to_numpy(dtype=np.int64)
        rest = counts[~counts["leaf"]]
        if len(rest):
            # Clusters and counts by chain and falling level; a count goes to the last cluster of its chain that came about at its level or above.
            inner = np.flatnonzero(~c["leaf"].to_numpy(dtype=bool))
            chain = c["chain"].to_numpy(dtype=np.int64)
            keys = np.concatenate([np.stack([chain[inner], -born[inner], np.zeros(len(inner), dtype=np.int64)]), np.stack([rest["chain"].to_numpy(dtype=np.int64), -rest["level"].to_numpy(dtype=np.int64), np.ones(len(rest), dtype=np.int64)])], axis=1)
            which = np.concatenate([inner, np.full(len(rest), -1)])
            order = np.lexsort((which, keys[2], keys[1], keys[0]))
            where = np.maximum.accumulate(np.where(which[order] >= 0, np.arange(len(order)), -1))
            found = which[order][where]
            counted = which[order] < 0
            row = order[counted] - len(inner)
            np.add.at(lost, found[counted], rest["n"].to_numpy(dtype=np.int64)[row])
            np.add.at(levels, found[counted], rest["sum"].to_numpy(dtype=np.int64)[row])
        start, below, flag = [0] * len(c), [0] * len(c), [False] * len(c)
        size = [0] * len(c)
        for i, (u, b, d, n, s) in enumerate(zip(up.tolist(), born.tolist(), died.tolist(), lost.tolist(), levels.tolist(), strict=True)):
            size[i] = start[i] + n
            stability = s + start[i] * b - size[i] * d
            flag[i] = stability > 0 and stability >= below[i]
            if u >= 0:
                start[u] += size[i]
                below[u] += max(stability, below[i])
        top = np.full(len(c), -1)
        for i in range(len(c) - 1, -1, -1):
            u = up[i]
            top[i] = top[u] if u >= 0 and top[u] >= 0 else i if flag[i] else -1
        leaf = np.flatnonzero(c["leaf"].to_numpy(dtype=bool) & (top >= 0))
        t = top[leaf]
        names = c["core"].to_numpy(dtype=np.int64)[leaf]
        smallest = np.full(len(c), np.iinfo(np.int64).max)
        np.minimum.at(smallest, t, names)
        return pd.DataFrame({"core": names, "top": smallest[t], "birth": died[t], "death": born[t], "leaf": c["leaf"].to_numpy(dtype=bool)[t], "size": np.array(size, dtype=np.int64)[t]})

    return run


def condensed(rows: DataFrame, skeleton: DataFrame, forest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows ``(id, core, level, step)``, what is chosen ``(core, top, birth, death, leaf, size)`` for every core below a chosen cluster, and the rows by ``(core, n)``.

    ``top`` is the smallest core of the chosen cluster, which nothing else chosen shares.
    """
    stats = forest.agg(F.max("w").alias("most"), F.percentile_approx("w", 0.5).alias("mid")).first()
    floor = max(1e-12, 1e-3 * (stats["mid"] or 0.0))
    root = int(np.floor(-np.log(max(stats["most"] or 1.0, floor)) * _STEPS))
    level = -F.log(F.greatest("w", F.lit(floor)))
    step = F.floor(level * _STEPS).cast("int")
    rows = cut(rows.select("id", "core", level.alias("level"), step.alias("step")))
    counts = cut(rows.groupBy("core", "step").agg(F.count("*").alias("n")))
    per = counts.groupBy("core").agg(F.max("step").alias("level"), F.sum("n").alias("n"))
    links = cut(skeleton.select("u", "v", "w", step.alias("level")).unionByName(per.select(F.col("core").alias("u"), F.col("core").alias("v"), F.lit(0.0).alias("w"), "level")))
    comp = cut(connected_components(links, "u", "v"))
    parts = links.join(comp.withColumnRenamed("id", "u"), "u")
    chains = cut(parts.groupBy("component").applyInPandas(lambda key, pdf: _chains(pdf).assign(component=key[0]), _CHAINS + ", component long"))
    stays = chains.filter("kind = 1").select("core", "component", "chain", "leaf", "born", "died")
    met = counts.join(stays, "core").filter("step <= born and step > died")
    met = met.groupBy("component", "chain", "leaf", F.when(F.col("leaf"), F.lit(0)).otherwise(F.col("step")).alias("level")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("step")).alias("sum"))
    none = lambda t: F.lit(0).cast(t)
    both = chains.filter("kind = 0").select("component", F.lit(0).alias("kind"), "cluster", "up", "chain", "born", "died", "core", "leaf", none("int").alias("level"), none("long").alias("n"), none("long").alias("sum"))
    both = both.unionByName(met.select("component", F.lit(2).alias("kind"), none("long").alias("cluster"), none("long").alias("up"), "chain", none("int").alias("born"), none("int").alias("died"), none("long").alias("core"), "leaf", "level", "n", "sum"))
    chosen = cut(both.groupBy("component").applyInPandas(_choose(root), _CHOSEN))
    return rows, chosen, per.select("core", "n")


def members(points: DataFrame, found: Neighbours, min_samples: int = 5, min_size: int = 10, min_gap: float = 0.25) -> DataFrame:
    """``(cluster, node_id, level)``: the members of the chosen clusters; ``cluster`` is the smallest ``node_id``."""
    forest = cut(spanning_forest(reach_edges(found, min_samples), found.depth))
    all_rows, chosen, per = condensed(*cores(forest, found.depth, min_size), forest)
    # A core may hold a third of all rows; those with over a thousandth of them are under a thousand.
    homes = join_hot(all_rows, chosen, "core", per).filter("step > birth")
    homes = cut(homes.select("id", "top", "level", (F.col("leaf") | (F.col("step") <= F.col("death"))).alias("direct")))
    chosen = chosen.select("top", (F.col("birth") / _STEPS).alias("birth"), (F.col("death") / _STEPS).alias("death"), "size").distinct()
    steps = F.floor(F.col("level") * 32)  # equal levels of one cluster, a third of all rows perhaps, meet in few rows
    events = homes.filter("direct").groupBy("top", steps.alias("bin")).agg(F.min("level").alias("lo"), F.max("level").alias("hi"), F.count("*").alias("lost"))
    ends = chosen.select("top", F.floor(F.col("death") * 32).alias("bin"), F.col("death").alias("lo"), F.col("death").alias("hi"), F.lit(0).cast("long").alias("lost"))
    events = events.unionByName(ends).groupBy("top", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("lost").alias("lost"))
    w = Window.partitionBy("top").orderBy("bin")
    gaps = events.join(chosen.select("top", "birth", "size"), "top")
    gaps = gaps.withColumn("gap", F.col("lo") - F.coalesce(F.lag("hi").over(w), F.col("birth"))).withColumn("before", F.sum("lost").over(w) - F.col("lost"))
    gaps = gaps.filter(F.col("before") <= F.col("size") / 2).groupBy("top").agg(F.max(F.struct("gap", F.col("lo").alias("from"))).alias("g"))
    kept = gaps.select("top", F.col("g.gap").alias("gap"), F.col("g.from").alias("from")).filter(F.col("gap") >= min_gap)
    rows = homes.join(kept, "top").filter("not direct or level >= from").select("top", F.col("id").alias("node_id"), "level")
    if found.crowded is not None:
        vs = [f"v{i}" for i in range(found.dims)]
        first = found.base.join(found.crowded, vs).groupBy(*vs).agg(F.min("id").alias("first"), F.collect_list("id").alias("ids"))  # k + 1 rows each
        extra = points.join(first, vs).filter(~F.array_contains("ids", F.col("id"))).select("id", "first")
        rows = rows.unionByName(extra.join(rows, extra["first"] == rows["node_id"]).select("top", F.col("id").alias("node_id"), "level"))
    names = rows.groupBy("top").agg(F.min("node_id").alias("cluster"), F.count("*").alias("n")).filter(F.col("n") >= min_size).select("top", "cluster")
    return cut(rows.join(names, "top").select("cluster", "node_id", "level"))


def cluster(points: DataFrame, dims: int, neighbours: int = 10, block_rows: int = 16384, **how) -> DataFrame:
    return members(points, nearest(points, neighbours, dims, block_rows), **how)


def summaries(rows: DataFrame, exemplars: int = 3) -> DataFrame:
    """``(cluster, size, exemplars)``: the members that stay longest, most persistent first."""
    from papyrine.llm.topn import top_n

    best = top_n(rows, ["cluster"], "level", "node_id", exemplars)
    ids = best.groupBy("cluster").agg(F.expr("transform(array_sort(collect_list(struct(-level as l, node_id))), e -> e.node_id)").alias("exemplars"))
    return rows.groupBy("cluster").agg(F.count("*").alias("size")).join(ids, "cluster")


def chain(rows: DataFrame, bucket: int = 65536) -> DataFrame:
    """``(node_a, node_b)``: members of one cluster that follow each other by ``node_id``.

    Neighbours are found within stretches of ``bucket`` identifiers; stretches are joined by their ends, so no task sorts a whole cluster.
    """
    at = rows.select("cluster", "node_id", F.floor(F.col("node_id") / bucket).alias("stretch"))
    w = Window.partitionBy("cluster", "stretch").orderBy("node_id")
    inner = at.select(F.lag("node_id").over(w).alias("node_a"), F.col("node_id").alias("node_b"))
    v = Window.partitionBy("cluster").orderBy("stretch")
    ends = at.groupBy("cluster", "stretch").agg(F.min("node_id").alias("lo"), F.max("node_id").alias("hi"))
    outer = ends.select(F.lag("hi").over(v).alias("node_a"), F.col("lo").alias("node_b"))
    return inner.unionByName(outer).filter("node_a is not null")
