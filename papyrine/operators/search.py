"""Searching parameters: grids, Latin hypercubes, target ranges, dimension sweeps."""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.rng import generator, shuffled, text_hash
from papyrine.operators import metrics
from papyrine.session import cut


def log_spaced_sizes(n: int, count: int = 25) -> list[int]:
    hi = max(4, n // 2)
    return sorted({max(2, math.floor(2 * (hi / 2) ** (i / max(1, count - 1)) + 0.5)) for i in range(count)})


def grid(axes: dict[str, list]) -> list[dict]:
    return [dict(zip(axes, values, strict=True)) for values in itertools.product(*axes.values())]


def latin_hypercube(schema: dict[str, dict], count: int, seed: int, fixed: dict | None = None) -> list[dict]:
    """``count`` settings whose values fall into different bins of every field; lists are gone through in turn, fields in ``fixed`` stay."""
    rng, columns = generator(seed), {}
    for name, f in schema.items():
        if fixed and name in fixed:
            columns[name] = [fixed[name]] * count
        elif "options" in f:
            columns[name] = shuffled([f["options"][i % len(f["options"])] for i in range(count)], rng)
        else:
            lo, hi = f["min"], f["max"]
            log = f.get("scale") == "log" and lo > 0
            a, b = (math.log(lo), math.log(hi)) if log else (lo, hi)
            values = [a + (i + rng()) / count * (b - a) for i in range(count)]
            values = [math.exp(v) for v in values] if log else values
            if f.get("kind") == "int":
                values = [int(min(hi, max(lo, math.floor(v + 0.5)))) for v in values]
            columns[name] = shuffled(values, rng)
    return [{name: c[i] for name, c in columns.items()} for i in range(count)]


def key(params: dict) -> str:
    """The same text for the same parameters, whatever their order."""
    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def neighbours(params: dict, schema: dict[str, dict], names: list[str], step: float = 0.1) -> list[dict]:
    """Settings one step of each named field up and down, within its range."""
    out = []
    for n in names:
        f = schema[n]
        width = max(1, round((f["max"] - f["min"]) * step)) if f.get("kind") == "int" else (f["max"] - f["min"]) * step
        for v in (params[n] - width, params[n] + width):
            v = min(f["max"], max(f["min"], v))
            if v != params[n] and {**params, n: v} not in out:
                out.append({**params, n: v})
    return out


def sweep(df: DataFrame, ident: str, vector: str, settings: list[dict], truth: DataFrame | None = None) -> DataFrame:
    """``(params, clusters, noise, ari)`` of density clusterings with every setting, each in a task of its own; best first.

    ``truth``: (node_id, label); without it ``ari`` is null.
    """
    out = across({"hdbscan": settings}, df, ident, vector, truth)
    return out.select("params", "clusters", "noise", "ari").orderBy(F.desc_nulls_last("ari"), F.desc("clusters"), "params")


def partitions(settings: dict[str, list[dict]], df: DataFrame, ident: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """``(job, node_id, b, noise)`` of clusterings by every setting of every algorithm, and the jobs ``(job, algorithm, params)``.

    Density clusterings run side by side, a task each; the others are distributed themselves and follow each other.
    """
    from papyrine.operators import clustering, hdbscan

    spark = df.sparkSession
    flat = [(a, s) for a, many in settings.items() for s in many]
    unknown = set(settings) - set(clustering.ALGORITHMS)
    if unknown:
        raise KeyError(f"no algorithm {', '.join(sorted(unknown))}; there are {', '.join(clustering.ALGORITHMS)}")
    jobs = spark.createDataFrame([(i, a, key(s)) for i, (a, s) in enumerate(flat)], "job int, algorithm string, params string")
    dense = {i: s for i, (a, s) in enumerate(flat) if a == "hdbscan"}
    parts = []
    if dense:
        rows = df.select(F.col(ident).cast("long").alias("node_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("job", F.explode(F.array(*(F.lit(i) for i in dense))))

        def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node_id")
            labels, flags, _, _ = hdbscan.run(np.stack(pdf["v"].to_numpy()), **dense[int(key_[0])])
            return pd.DataFrame({"job": int(key_[0]), "node_id": pdf["node_id"].to_numpy(), "b": labels, "noise": flags})

        parts.append(rows.groupBy("job").applyInPandas(run, "job int, node_id long, b long, noise boolean"))
    for i, (a, s) in enumerate(flat):
        if a != "hdbscan":
            one = clustering.infer(a, df, ident, vector, **s)
            parts.append(one.select(F.lit(i).alias("job"), F.col("node_id").cast("long").alias("node_id"), F.col("node_cluster").cast("long").alias("b"), F.lit(False).alias("noise")))
    return cut(reduce(DataFrame.unionByName, parts)), jobs


def swept_settings(names: list[str]) -> dict[str, list[dict]]:
    """For each algorithm the grid of the values its parameters are swept over."""
    from papyrine.operators import clustering

    return {n: grid({p: f["sweep"] for p, f in clustering.ALGORITHMS[n].items()}) for n in names}


def across(settings: dict[str, list[dict]], df: DataFrame, ident: str, vector: str, truth: DataFrame | None = None, scorer: str = "ari", top: int | None = None, **bootstrap) -> DataFrame:
    """``(algorithm, params, clusters, noise, ari, macro, score)`` of every setting of every algorithm, best score first, ties by more clusters; ``top``: only the best so many.

    ``scorer``: one of ``scored``; those that need it bootstrap every clustering with its own algorithm's settings (density clusterings).
    """
    from papyrine.operators import clustering

    found, jobs = partitions(settings, df, ident, vector)
    out = found.groupBy("job").agg(F.countDistinct("b").alias("clusters"), F.count_if("noise").alias("noise"))
    if truth is None:
        out = out.withColumn("ari", F.lit(None).cast("double"))
    else:
        table = found.join(truth.select("node_id", F.col("label").alias("a")), "node_id").groupBy("job", "a", "b").agg(F.count("*").alias("n"))
        out = out.join(metrics.scores(table, ["job"]).select("job", "ari"), "job", "left")
    out = out.join(jobs, "job").withColumn("macro", F.lit(None).cast("double"))
    if scorer in ("stability", "richness"):
        stable = []
        for i, s in enumerate(s for many in settings.values() for s in many):
            ref = found.filter(F.col("job") == i).select("node_id", F.col("b").alias("node_cluster"))
            each = clustering.bootstrap(df, ident, vector, ref, **{"seed": seed_of(s), **bootstrap}, **s)
            stable.append(clustering.stability_summary(each).select(F.lit(i).alias("job"), F.col("macro").alias("m")))
        out = out.drop("macro").join(cut(reduce(DataFrame.unionByName, stable)).withColumnRenamed("m", "macro"), "job", "left")
    ranked = scored(out.select("algorithm", "params", "clusters", "noise", "ari", "macro"), scorer).orderBy(F.desc_nulls_last("score"), F.desc("clusters"), "algorithm", "params")
    return ranked.limit(top) if top else ranked


def seed_of(params: dict, seed: int = 12345) -> int:
    """A seed that depends on the parameters only, not on the order in which settings are tried."""
    return (text_hash(key(params)) ^ seed) % 2**31


def target_range(df: DataFrame, ident: str, vector: str, schema: dict[str, dict], low: int, high: int, probes: int = 12, seed: int = 42, step: float = 0.1, bootstrap: dict | None = None) -> DataFrame:
    """``(params, clusters, in_range, score)``: settings that give between ``low`` and ``high`` clusters; a probe, then what fits (or the three closest to the range) and its neighbours.

    The score is nearness to the middle of the range; with ``bootstrap``, parameters of ``clustering.bootstrap``, the mean Jaccard of the clusters when they're found again in subsamples.
    """
    from papyrine.operators import clustering

    if not 1 <= low <= high:
        raise ValueError(f"{low} to {high} isn't a range of cluster numbers")
    first = latin_hypercube(schema, probes, seed)
    first = list({key(p): p for p in first}.values())
    found, jobs = partitions({"hdbscan": first}, df, ident, vector)
    sizes = found.groupBy("job").agg(F.countDistinct("b").alias("clusters"))
    rows = [(key(first[r["job"]]), first[r["job"]], r["clusters"]) for r in sizes.collect()]  # one row a probe
    fit = [r for r in rows if low <= r[2] <= high] or sorted(rows, key=lambda r: (max(0, low - r[2], r[2] - high), r[0]))[:3]
    more = {r[0]: r[1] for r in fit}
    for r in fit:
        more |= {key(p): p for p in neighbours(r[1], schema, list(schema), step)}
    known = {key(p): i for i, p in enumerate(first)}
    new = [p for k, p in more.items() if k not in known]
    kept = found.filter(F.col("job").isin([known[k] for k in more if k in known]))
    if new:
        again, _ = partitions({"hdbscan": new}, df, ident, vector)
        kept = kept.unionByName(again.withColumn("job", F.col("job") + len(first)))
    settings = {known[k]: p for k, p in more.items() if k in known} | {len(first) + i: p for i, p in enumerate(new)}
    names = df.sparkSession.createDataFrame([(i, key(p)) for i, p in settings.items()], "job int, params string")
    out = kept.groupBy("job").agg(F.countDistinct("b").alias("clusters")).join(names, "job")
    if bootstrap is None:
        out = out.withColumn("score", 1 / (1 + F.abs(F.col("clusters") - F.lit((low + high) / 2))))
    else:
        parts = []
        for i, p in settings.items():
            each = clustering.bootstrap(df, ident, vector, kept.filter(F.col("job") == i).select("node_id", F.col("b").alias("node_cluster")), **{"seed": seed_of(p, seed), **bootstrap}, **p)
            parts.append(clustering.stability_summary(each).select(F.lit(i).alias("job"), F.coalesce("unweighted", F.lit(0.0)).alias("score")))
        out = out.join(cut(reduce(DataFrame.unionByName, parts)), "job")
    inside = F.col("clusters").between(low, high)
    return out.select("params", "clusters", inside.alias("in_range"), "score").orderBy(F.desc("in_range"), F.desc("score"), F.desc("clusters"), "params")


def dimension_runs(df: DataFrame, ident: str, vector: str, dims: list[int], seeds: list[int], noise: int = 50, neighbours: int = 15, epochs: int = 200, **how) -> DataFrame:
    """``(d, s, node_id, node_cluster)``: for each number of dimensions and seed the vectors are embedded anew and clustered.

    Principal components and neighbour links are the same for all runs and found once; each run is placed and clustered in a task of its own.
    """
    from papyrine.operators import hdbscan
    from papyrine.operators.dimred import place, umap_links
    from papyrine.operators.vectors import pca

    if len(dims) < 2 or not seeds:
        raise ValueError("two dimensions and a seed are wanted at least")
    less, _ = pca(df, ident, vector, noise)
    links = cut(umap_links(cut(less), ident, "vec", neighbours))
    each = links.withColumn("d_", F.explode(F.array(*(F.lit(d) for d in dims)))).withColumn("s_", F.explode(F.array(*(F.lit(s) for s in seeds))))

    def run(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, s = int(key_[0]), int(key_[1])
        own, y = place(pdf, d, neighbours, epochs, s)
        return pd.DataFrame({"d": d, "s": s, "node_id": own, "node_cluster": hdbscan.run(y, **how)[0]})

    return cut(each.groupBy("d_", "s_").applyInPandas(run, "d int, s int, node_id long, node_cluster long"))


def compared_dimensions(runs: DataFrame) -> DataFrame:
    """``(d1, d2, mean, sd, clusters_1, clusters_2)``: agreement of the partitions of different dimensions, seed by seed; 1 with itself."""
    a, b = (runs.select("node_id", "s", F.col("d").alias(f"d{i}"), F.col("node_cluster").alias(c)) for i, c in ((1, "a"), (2, "b")))
    table = a.join(b, ["node_id", "s"]).filter("d1 <= d2").groupBy("d1", "d2", "s", "a", "b").agg(F.count("*").alias("n"))
    each = metrics.scores(table, ["d1", "d2", "s"])
    counts = runs.groupBy("d", "s").agg(F.countDistinct("node_cluster").alias("k")).groupBy("d").agg(F.avg("k").alias("k"))
    out = each.groupBy("d1", "d2").agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("sd"))
    return out.join(counts.select(F.col("d").alias("d1"), F.col("k").alias("clusters_1")), "d1").join(counts.select(F.col("d").alias("d2"), F.col("k").alias("clusters_2")), "d2")


def dimension_sweep(df: DataFrame, ident: str, vector: str, dims: list[int], seeds: list[int], min_size: int = 15, **how) -> DataFrame:
    return compared_dimensions(dimension_runs(df, ident, vector, dims, seeds, min_size=min_size, **how))


def dimension_cost(n: int, dims: list[int], seeds: list[int], base: float = 8.0) -> float:
    """Seconds a dimension sweep may take, in proportion to rows and dimensions; ``base``: an embedding of 5,000 rows in 50 dimensions."""
    return max(0.3, 3 * n / 5000) + len(seeds) * sum(base * max(0.05, n / 5000) * max(0.3, d / 50) for d in dims)


def dimension_verdict(result: DataFrame, d1: int, d2: int, threshold: float = 0.9) -> DataFrame:
    return result.filter((F.col("d1") == min(d1, d2)) & (F.col("d2") == max(d1, d2))).select("d1", "d2", (F.col("mean") > threshold).alias("redundant"))


def scored(results: DataFrame, scorer: str) -> DataFrame:
    """``results`` of clusterings with a ``score``, best first: "ari" with the truth, "clusters" their number, "stability" the mean Jaccard, "richness" both multiplied."""
    score = {"ari": F.col("ari"), "clusters": F.col("clusters").cast("double"), "stability": F.col("macro"), "richness": F.col("clusters") * F.col("macro")}
    if scorer not in score:
        raise KeyError(f"no scorer {scorer!r}; there are {', '.join(score)}")
    return results.withColumn("score", score[scorer]).orderBy(F.desc_nulls_last("score"), F.desc("clusters"), "params")


def tagged(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several passes as one table with the pass as ``source``."""
    return reduce(DataFrame.unionByName, [d.withColumn("source", F.lit(name)) for name, d in results.items()])


def layout_sweep(nodes: DataFrame, edges: DataFrame, base: DataFrame, methods: tuple[str, ...] = ("forces", "mds", "umap-graph"), seeds: tuple[int, ...] = (1, 2), top: int = 6) -> DataFrame:
    """``(method, seed, correlation)`` of layouts aligned with positions component by component, best first."""
    from papyrine.operators import layout

    jobs = list(itertools.product(methods, seeds))
    comp = layout.components(nodes, edges)
    placed = cut(layout.layouts([(m, s, {}) for m, s in jobs], nodes, edges, comp))
    names = nodes.sparkSession.createDataFrame([(i, m, s) for i, (m, s) in enumerate(jobs)], "job int, method string, seed int")
    found = names.join(layout.correlations(base, placed, comp), "job", "left").select("method", "seed", F.coalesce("correlation", F.lit(0.0)).alias("correlation"))
    return found.orderBy(F.desc("correlation"), "method", "seed").limit(top)
