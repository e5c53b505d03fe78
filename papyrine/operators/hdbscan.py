"""Hierarchical density clustering of one group of vectors in one task, with the conventions of small interactive analyses.

Core distances leave the point itself out; levels are 1 / distance; points that go on into a cluster's children count with the highest level at
which one fell out of the cluster itself; a cluster is preferred to its children only if it is strictly more stable; the root is chosen only if it
has no children. Groups are meant to be a level, a parent cluster or a bootstrap sample of some thousand rows; for whole corpora the
neighbour-graph method that works in blocks is the one to use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import cut


@dataclass
class Model:
    """What doesn't depend on the minimum cluster size: mutual reachability and its spanning tree, light edges first."""

    reach: np.ndarray
    edges: np.ndarray  # (n - 1, 2)
    weights: np.ndarray
    core: np.ndarray


@dataclass
class Tree:
    """Condensed clusters, parents before children; where and when every point falls out."""

    parent: list[int] = field(default_factory=list)
    birth: list[float] = field(default_factory=list)
    stability: list[float] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    home: np.ndarray = None
    leaf_level: np.ndarray = None

    def children(self) -> list[list[int]]:
        out = [[] for _ in self.parent]
        for c, p in enumerate(self.parent):
            if p >= 0:
                out[p].append(c)
        return out


def fit(x: np.ndarray, min_samples: int = 5) -> Model:
    n = len(x)
    x = np.asarray(x, dtype=np.float64)
    sq = (x**2).sum(1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)).astype(np.float32).astype(np.float64)
    np.fill_diagonal(d, 0)
    if n < 2:
        return Model(d, np.zeros((0, 2), dtype=int), np.zeros(0), np.zeros(n))
    core = np.partition(d + np.diag(np.full(n, np.inf)), min(max(min_samples, 1) - 1, n - 2), axis=1)[:, min(max(min_samples, 1) - 1, n - 2)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, near, via = np.zeros(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=int)
    at, edges, weights = 0, [], []
    inside[0] = True
    for _ in range(n - 1):
        closer = reach[at] < near
        near[closer], via[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, near).argmin())
        inside[at] = True
        edges.append((via[at], at))
        weights.append(near[at])
    order = np.argsort(weights, kind="stable")
    return Model(reach, np.array(edges)[order], np.array(weights)[order], core)


def condense(model: Model, min_size: int) -> Tree:
    n = len(model.core)
    root_of = list(range(n))

    def find(i):
        while root_of[i] != i:
            root_of[i] = root_of[root_of[i]]
            i = root_of[i]
        return i

    size, members, cluster = [1] * n, [[i] for i in range(n)], [None] * n
    made: list[dict] = []  # children before parents
    home, leaf = np.full(n, -1), np.zeros(n)

    def drop(points, c, level):
        made[c]["falls"].append((level, len(points)))
        for p in points:
            home[p], leaf[p] = c, level

    for (a, b), w in zip(model.edges.tolist(), model.weights.tolist(), strict=True):
        level = 1 / w if w > 0 else np.inf
        i, j = find(a), find(b)
        if size[i] < size[j]:
            i, j = j, i
        if size[j] >= min_size:
            made.append({"below": [cluster[i], cluster[j]], "falls": [], "size": 0, "through": size[i] + size[j]})
            for c, s in ((cluster[i], size[i]), (cluster[j], size[j])):
                made[c]["birth"], made[c]["size"] = level, s
            cluster[i] = len(made) - 1
        elif size[i] >= min_size:
            drop(members[j], cluster[i], level)
        else:
            members[i] = members[i] + members[j]
            if size[i] + size[j] >= min_size:
                made.append({"below": [], "falls": [], "size": 0, "through": 0})
                cluster[i] = len(made) - 1
                drop(members[i], cluster[i], level)
        members[j] = None
        size[i] += size[j]
        root_of[j] = i
    top = find(0) if n else 0
    tree = Tree()
    if not n or cluster[top] is None:  # fewer points than a cluster needs: a root that holds all
        tree.parent, tree.birth, tree.stability, tree.size = [-1], [0.0], [0.0], [n]
        tree.home, tree.leaf_level = np.zeros(n, dtype=int), np.zeros(n)
        return tree
    made[cluster[top]]["birth"], made[cluster[top]]["size"] = 0.0, n
    number: dict[int, int] = {}
    work = [(cluster[top], -1)]
    while work:
        c, p = work.pop()
        number[c] = len(tree.parent)
        m = made[c]
        own = [lv for lv, _ in m["falls"] if np.isfinite(lv)]
        last = max([m["birth"], *own])
        s = sum(max(0.0, lv - m["birth"]) * k for lv, k in m["falls"] if np.isfinite(lv)) + max(0.0, last - m["birth"]) * m["through"]
        tree.parent.append(p), tree.birth.append(m["birth"]), tree.stability.append(s), tree.size.append(m["size"])
        work += [(b, number[c]) for b in reversed(m["below"])]
    tree.home, tree.leaf_level = np.array([number[h] for h in home]), leaf
    return tree


def select(tree: Tree, method: str = "eom", epsilon: float = 0.0) -> list[int]:
    kids = tree.children()
    if method == "leaf":
        chosen = [c for c in range(len(kids)) if tree.parent[c] >= 0 and not kids[c]]
    else:
        best = [0.0] * len(kids)
        taken: list[bool] = [False] * len(kids)
        for c in reversed(range(len(kids))):
            below = sum(best[k] for k in kids[c])
            taken[c] = not kids[c] or tree.stability[c] > below
            best[c] = tree.stability[c] if taken[c] else below
        chosen, work = [], [0]
        if taken[0] and kids[0]:  # everything as one cluster: its children stand on their own
            work = []
            down = list(kids[0])
            while down:
                c = down.pop()
                if not kids[c] or tree.stability[c] > 0:
                    chosen.append(c)
                else:
                    down += kids[c]
        while work:
            c = work.pop()
            if taken[c]:
                chosen.append(c)
            else:
                work += kids[c]
    if epsilon > 0:
        merged = set()
        for c in chosen:
            while tree.birth[c] > 1 / epsilon and tree.parent[c] > 0:
                c = tree.parent[c]
            merged.add(c)
        chosen = list(merged)
    return sorted(chosen)


def label(tree: Tree, chosen: list[int]) -> np.ndarray:
    """The deepest chosen cluster above each point's home, -1 without; clusters numbered by their first point."""
    above = np.full(len(tree.parent), -1)
    for c in range(len(tree.parent)):
        above[c] = c if c in set(chosen) else above[tree.parent[c]] if tree.parent[c] >= 0 else -1
    return above[tree.home]


def relabel(raw: np.ndarray) -> tuple[np.ndarray, list[int]]:
    seen: dict[int, int] = {}
    out = np.array([-1 if v < 0 else seen.setdefault(int(v), len(seen)) for v in raw], dtype=np.int64)
    return out, list(seen)


def absorb(labels: np.ndarray, order: list[int], tree: Tree, model: Model) -> np.ndarray:
    """Noise goes to the cluster with the largest level times stability that it reaches after the cluster's birth, else to the nearest."""
    out = labels.copy()
    if not order:
        return np.zeros_like(out)
    noise = np.flatnonzero(labels < 0)
    if not len(noise):
        return out
    near = np.stack([model.reach[noise][:, labels == k].min(1) for k in range(len(order))], 1)
    with np.errstate(divide="ignore"):
        level = 1 / near
    birth, stab = (np.array([v[c] for c in order]) for v in (tree.birth, tree.stability))
    usable = stab > 0
    score = np.where((level >= birth) & usable, level * stab, -np.inf)
    nearest = np.where(usable, near, np.inf).argmin(1)
    out[noise] = np.where(np.isfinite(score.max(1)) | (score.max(1) == np.inf), score.argmax(1), nearest)
    return out


def run(x: np.ndarray, min_size: int = 15, min_samples: int = 5, method: str = "eom", epsilon: float = 0.0, noise: str = "absorb", model: Model | None = None):
    """Labels, noise flags, the tree and the chosen clusters in the order of their labels."""
    n = len(x)
    if n < 2:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), None, []
    model = model or fit(x, min_samples)
    tree = condense(model, max(2, min_size))
    labels, order = relabel(label(tree, select(tree, method, epsilon)))
    flags = labels < 0
    if noise == "absorb":
        labels = absorb(labels, order, tree, model)
    elif noise == "singletons":
        labels = labels.copy()
        labels[flags] = len(order) + np.arange(flags.sum())
    return labels, flags, tree, order


# --- levels of one tree -----------------------------------------------------------------------------------------------

def layers(tree: Tree, cap: int = 5, least: int = 2) -> list[tuple[int, float, float]]:
    """``(count, level, persistence)`` of the numbers of clusters that persist over the widest ranges of levels, coarse to fine."""
    finite = [b for b in tree.birth if np.isfinite(b)] + [v for v in tree.leaf_level if np.isfinite(v)]
    most = max(finite, default=0.0)
    if most <= 0 or len(tree.parent) < 2:
        return []
    ends = [min([tree.birth[k] for k in kids], default=np.inf) for kids in tree.children()]
    spans = [(tree.birth[c], min(ends[c], most)) for c in range(1, len(tree.parent))]
    steps = pd.Series({}, dtype=float)
    steps = pd.concat([pd.Series(1, index=[a for a, b in spans if b > a]), pd.Series(-1, index=[b for a, b in spans if b > a])]).groupby(level=0).sum().sort_index()
    level, count = steps.index.to_numpy(), steps.cumsum().to_numpy()
    seg = pd.DataFrame({"lo": level[:-1], "hi": level[1:], "count": count[:-1]})
    seg = seg[(seg["count"] >= least) & (seg["lo"] > 0)].assign(width=lambda s: np.log(s["hi"] / s["lo"]))
    if not len(seg):
        return []
    total = seg.groupby("count")["width"].sum()
    widest = seg.loc[seg.groupby("count")["width"].idxmax()].set_index("count")
    kept = total.sort_values(ascending=False, kind="stable").head(cap).sort_index()
    return [(int(c), float(np.sqrt(widest.loc[c, "lo"] * widest.loc[c, "hi"])), float(t)) for c, t in kept.items()]


def frontier(tree: Tree, level: float) -> np.ndarray:
    """The cluster each point is in at a level, -1 if it has fallen out."""
    at = np.arange(len(tree.parent))
    for c in range(len(tree.parent)):  # parents first
        if tree.birth[c] > level and tree.parent[c] >= 0:
            at[c] = at[tree.parent[c]]
    return np.where(tree.leaf_level < level, -1, at[tree.home])


def absorb_along_tree(labels: np.ndarray, edges: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unlabelled points take the label of the nearest labelled one along the spanning tree."""
    import heapq

    near: list[list] = [[] for _ in labels]
    for (a, b), w in zip(np.asarray(edges).tolist(), np.asarray(weights).tolist(), strict=True):
        near[a].append((b, w))
        near[b].append((a, w))
    out = labels.copy()
    queue = [(0.0, i, int(labels[i])) for i in np.flatnonzero(labels >= 0).tolist()]
    heapq.heapify(queue)
    done = np.zeros(len(labels), dtype=bool)
    while queue:
        d, i, k = heapq.heappop(queue)
        if done[i]:
            continue
        done[i], out[i] = True, k
        for j, w in near[i]:
            if not done[j]:
                heapq.heappush(queue, (d + w, j, k))
    return out


def ladder(model: Model, min_size: int, cap: int = 5) -> list[np.ndarray]:
    """Labels of the persistent layers, coarse to fine, each with more clusters than the one before."""
    tree, out, before = condense(model, min_size), [], 0
    for _, level, _ in layers(tree, cap):
        labels, order = relabel(frontier(tree, level))
        labels = absorb_along_tree(labels, model.edges, model.weights)
        if len(order) > before:
            out.append(labels)
            before = len(order)
    return out


# --- on DataFrames -----------------------------------------------------------------------------------------------------

def cluster(df: DataFrame, ident: str, vector: str, by: str | None = None, **params) -> DataFrame:
    """``([by,] node_id, node_cluster, noise_flag)``: every group clustered in a task of its own."""
    src = df.select(F.col(ident).cast("long").alias("node_id"), F.col(vector).cast("array<double>").alias("v"), *([by] if by else [])).filter("v is not null")
    kind = f"{by} {src.schema[by].dataType.simpleString()}, " if by else ""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        labels, flags, _, _ = run(np.stack(pdf["v"].to_numpy()), **params)
        out = pd.DataFrame({"node_id": pdf["node_id"].to_numpy(), "node_cluster": labels, "noise_flag": flags})
        if by:
            out.insert(0, by, pdf[by].iloc[0])
        return out

    return src.groupBy(*([by] if by else [])).applyInPandas(one, f"{kind}node_id long, node_cluster long, noise_flag boolean")


def tree_tables(df: DataFrame, ident: str, vector: str, min_size: int, min_samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """The condensed tree ``(cluster, parent, birth, stability, size)`` and its leaves ``(node_id, home, level)``."""
    src = df.select(F.col(ident).cast("long").alias("node_id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        t = condense(fit(np.stack(pdf["v"].to_numpy()), min_samples), min_size)
        clusters = pd.DataFrame({"leaf": False, "node_id": 0, "cluster": range(len(t.parent)), "parent": t.parent, "level": t.birth, "stability": t.stability, "size": t.size})
        leaves = pd.DataFrame({"leaf": True, "node_id": pdf["node_id"].to_numpy(), "cluster": t.home, "parent": 0, "level": t.leaf_level, "stability": 0.0, "size": 0})
        return pd.concat([clusters, leaves])

    both = cut(src.groupBy().applyInPandas(grow, "leaf boolean, node_id long, cluster long, parent long, level double, stability double, size long"))  # one model for both tables
    return both.filter("not leaf").select("cluster", "parent", F.col("level").alias("birth"), "stability", "size"), both.filter("leaf").select("node_id", F.col("cluster").alias("home"), "level")


def ladder_levels(df: DataFrame, ident: str, vector: str, min_size: int, min_samples: int = 5, cap: int = 5) -> DataFrame:
    """``(level_no, node_id, node_cluster)`` of the persistent layers of one tree, coarse to fine."""
    src = df.select(F.col(ident).cast("long").alias("node_id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")

    def run_levels(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        found = ladder(fit(np.stack(pdf["v"].to_numpy()), min_samples), min_size, cap)
        parts = [pd.DataFrame({"level_no": i, "node_id": pdf["node_id"].to_numpy(), "node_cluster": lv}) for i, lv in enumerate(found)]
        return pd.concat(parts) if parts else pd.DataFrame({"level_no": [], "node_id": [], "node_cluster": []}).astype("int64")

    return src.groupBy().applyInPandas(run_levels, "level_no int, node_id long, node_cluster long")
