"""Labels of clusters from the texts, years and vectors of their members."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions.text import is_junk, phrases, tokens
from papyrine.session import cut

METHODS = ("representative", "year", "tfidf", "cTfidf", "keybert", "tfidfStratified", "cTfidfStratified", "keybertStratified")
BANDS = ("anchor", "broad", "mid", "specific", "signature")


def term_scores(texts: DataFrame, longest: int = 1, boost: float = 0.0) -> DataFrame:
    """``(cluster, term, count, df, score)`` for ``(cluster, text)``.

    The score is the term's share of the cluster's terms times ln(1 + N / (1 + df)), N being the number of clusters and df of those with
    the term; ``boost`` adds to it for every further word of a phrase. Counts are combined before anything is shuffled by term.
    """
    counts = texts.filter("cluster is not null and text is not null").select("cluster", F.explode(phrases(tokens(F.col("text")), longest)).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("count"))
    counts = cut(counts)  # used three times; texts are gone through once
    total = counts.groupBy("cluster").agg(F.sum("count").alias("total"))  # one row a cluster
    clusters = texts.filter("cluster is not null").agg(F.countDistinct("cluster").alias("clusters"))  # one row
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    j = counts.join(df, "term").join(total, "cluster").crossJoin(F.broadcast(clusters))
    score = F.col("count") / F.col("total") * F.log(1 + F.col("clusters") / (1 + F.col("df")))
    if boost:
        score = score * (1 + boost * (F.size(F.split("term", " ")) - 1))
    return j.select("cluster", "term", "count", "df", score.alias("score"))


def top_terms(scores: DataFrame, n: int = 4, digits: int = 9) -> DataFrame:
    """``(cluster, rank, term, score)``; ties (after rounding) to the smaller term."""
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", digits)), "term")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("cluster", "rank", "term", F.round("score", digits).alias("score"))


def diverse(pool: list[tuple[str, float]], n: int, weight: float = 0.6) -> list[tuple[str, float]]:
    """Picks with the largest weighted relevance less the overlap with what is picked; the pool is in order of relevance."""
    words = {t: set(t.split(" ")) for t, _ in pool}
    out: list[tuple[str, float]] = []
    left = list(pool)
    while left and len(out) < n:
        def gain(c):
            near = max((len(words[c[0]] & words[p]) / len(words[c[0]] | words[p]) for p, _ in out), default=0.0)
            return weight * c[1] - (1 - weight) * near if out else c[1]

        best = max(range(len(left)), key=lambda i: (gain(left[i]), -i))
        out.append(left.pop(best))
    return out


def keyphrases(texts: DataFrame, n: int = 4, pool: int = 30) -> DataFrame:
    """``(cluster, rank, term, score)``: phrases of one or two words, chosen for relevance and difference from a pool of the ``pool`` most relevant."""
    best = top_terms(term_scores(texts, 2, 0.15), pool)
    kind = best.schema["cluster"].dataType.simpleString()

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        got = diverse(list(zip(pdf["term"], pdf["score"], strict=True)), n)
        return pd.DataFrame({"cluster": key[0], "rank": range(1, len(got) + 1), "term": [t for t, _ in got], "score": [s for _, s in got]})

    return best.groupBy("cluster").applyInPandas(pick, f"cluster {kind}, rank int, term string, score double")


def band_edges(most: int) -> list[int]:
    edges: list[int] = []
    for k in (1, 2, 3):
        edges.append(max(math.floor(max(most, 2) ** (k / 4) + 0.5), (edges[-1] if edges else 1) + 1))
    return edges


def banded(texts: DataFrame, n: int = 3, longest: int = 2, boost: float = 0.15, mmr: bool = False, candidates: int = 60) -> DataFrame:
    """``(cluster, band, rank, term, df, score)``: terms in bands from those of many clusters ("anchor") to those of one ("signature").

    A single word already part of a chosen phrase of its band is passed over; numbers and foreign function words don't sign. At most ``candidates`` best
    terms of a band are looked at, many more than can be passed over.
    """
    s = cut(term_scores(texts, longest, boost))  # used for the bands' edges and for the terms
    edges = band_edges(s.agg(F.max("df")).first()[0] or 2)
    df = F.col("df")
    band = F.when(df == 1, "signature").when(df <= edges[0], "specific").when(df <= edges[1], "mid").when(df <= edges[2], "broad").otherwise("anchor")
    s = s.withColumn("band", band).filter((F.col("band") != "signature") | ~is_junk(F.col("term")))
    w = Window.partitionBy("cluster", "band").orderBy(F.desc(F.round("score", 9)), "term")
    pool = s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= candidates)
    kind = s.schema["cluster"].dataType.simpleString()

    def pick(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        if mmr:
            keep = [t for t, _ in diverse(list(zip(pdf["term"], pdf["score"], strict=True)), n)]
        else:
            keep = []
            for t in pdf["term"]:
                if len(keep) < n and not (" " not in t and any(t in k.split(" ") for k in keep)):
                    keep.append(t)
        rows = pdf.set_index("term").loc[keep]
        return pd.DataFrame({"cluster": key[0], "band": key[1], "rank": range(1, len(keep) + 1), "term": keep, "df": rows["df"].to_numpy(), "score": rows["score"].round(9).to_numpy()})

    return pool.groupBy("cluster", "band").applyInPandas(pick, f"cluster {kind}, band string, rank int, term string, df long, score double")


def combined(methods: dict[str, DataFrame], clusters: DataFrame) -> DataFrame:
    """``(cluster, label)`` by the first method that has something: key phrases, bands, terms, the representative with its median year, the years."""
    joined = lambda d: d.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda e: e["term"]), " · ").alias("t"))
    out, options = clusters.select("cluster").distinct(), []
    for name in ("keybert", "banded", "cTfidf", "tfidf"):
        if name in methods:
            d = methods[name]
            if name == "banded":
                first = lambda *bands: F.coalesce(*(F.max(F.when((F.col("band") == b) & (F.col("rank") == 1), F.col("term"))) for b in bands))
                t = d.groupBy("cluster").agg(F.concat_ws(" · ", first("anchor", "broad"), first("signature", "specific", "mid")).alias("t")).filter("t <> ''")
            else:
                t = joined(d)
            out = out.join(t.withColumnRenamed("t", name), "cluster", "left")
            options.append(F.col(name))
    if "year" in methods:
        out = out.join(methods["year"].select("cluster", "first_year", "last_year", "median"), "cluster", "left")
    if "representative" in methods:
        out = out.join(methods["representative"].select("cluster", F.col("representative").cast("string").alias("rep")), "cluster", "left")
        year = F.coalesce(F.concat(F.lit(" ("), F.col("median").cast("string"), F.lit(")")), F.lit("")) if "year" in methods else F.lit("")
        options.append(F.concat("rep", year))
    if "year" in methods:
        options.append(F.concat(F.col("first_year").cast("string"), F.lit("–"), F.col("last_year").cast("string")))
    return out.select("cluster", F.coalesce(*options, F.lit("(unlabelled)")).alias("label"))


def available(texts: DataFrame | None, vectors: DataFrame | None, years: DataFrame | None) -> dict[str, str | None]:
    """For each method why it can't run, or None if it can."""
    has = lambda d, c: d is not None and not d.filter(F.col(c).isNotNull()).isEmpty()
    why_text = None if texts is not None and not texts.filter(F.trim("text") != "").isEmpty() else "needs texts"
    reasons = {m: why_text for m in METHODS}
    reasons["representative"] = None if has(vectors, "vec") else "needs vectors"
    reasons["year"] = None if has(years, "year") else "needs years"
    return reasons
