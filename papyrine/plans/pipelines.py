"""Whole analyses: reduce, cluster, analyse, label, score, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.operators import analytics, clustering, dimred, labels, layout
from papyrine.plans.workflow import Task, run_graph
from papyrine.session import cut


def reduction(vectors: DataFrame, ident: str, vector: str, edges: DataFrame | None = None, noise: str = "pca", compression: int = 3, alpha: float = 0.5, spark=None) -> dict:
    """The stages noise → fusion → compression, and the compression before fusion where there are links; independent stages run at the same time."""

    def fuse(done):
        return cut(dimred.diffuse(done["noise"].select(F.col(ident).alias("node_id"), "vec"), edges, alpha).select(F.col("node_id").alias(ident), "vec"))

    small = lambda d: cut(dimred.reduce("pca", d, ident, "vec", components=compression))
    tasks = {
        "noise": Task(lambda _: cut(dimred.reduce(noise, vectors, ident, vector, **({"components": 50} if noise == "pca" else {})))),
        "fusion": Task(fuse, ("noise",), edges is not None),
        "compression": Task(lambda d: small(d["fusion"] if d["fusion"] is not None else d["noise"]), ("noise", "fusion")),
        "before": Task(lambda d: small(d["noise"]), ("noise",), edges is not None),
    }
    return run_graph(tasks, spark, "reduction")


def bridge_job(assign: DataFrame, levels: DataFrame) -> dict[str, DataFrame]:
    if levels.count() < 2:
        raise ValueError("bridges need two levels")
    return {"all": analytics.bridges(analytics.level_pairs(assign, levels)), "adjacent": analytics.bridges(analytics.level_pairs(assign, levels, adjacent=True))}


def flow_job(assign: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    if edges.isEmpty():
        raise ValueError("flow needs citations")
    m = analytics.flow(assign, edges)
    return {"flow": m, "degrees": analytics.flow_degrees(m), "fractions": analytics.out_fractions(m)}


def labelling_job(texts: DataFrame, methods: tuple[str, ...] = ("keybert", "cTfidf")) -> dict[str, DataFrame]:
    run = {
        "tfidf": lambda: labels.top_terms(labels.term_scores(texts)),
        "cTfidf": lambda: labels.top_terms(labels.term_scores(texts)),
        "keybert": lambda: labels.keyphrases(texts),
        "tfidfStratified": lambda: labels.banded(texts, longest=1, boost=0.0),
        "cTfidfStratified": lambda: labels.banded(texts, longest=1, boost=0.0),
        "keybertStratified": lambda: labels.banded(texts, mmr=True),
    }
    out = {m: run[m]() for m in methods}
    named = {("banded" if m.endswith("Stratified") else m): d for m, d in out.items()}
    return out | {"combined": labels.combined(named, texts.select("cluster"))}


def displacement_job(before: DataFrame, after: DataFrame, most: int = 100) -> DataFrame:
    return layout.displacement(before, after).orderBy(F.desc("moved"), "node_id").limit(most)


def bootstrap_job(df: DataFrame, ident: str, vector: str, reference: DataFrame, **how) -> dict[str, DataFrame]:
    each = cut(clustering.bootstrap(df, ident, vector, reference, **how))
    return {"clusters": each, "summary": clustering.stability_summary(each)}
