"""Vectors: similarity, exact nearest neighbours in blocks, principal components, k-means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.operators import space


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a vector without length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, 1 - dot(a, b) / n).otherwise(1.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``(group, mean)``."""
    flat = df.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return flat.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("mean"))


def cosine_to_mean(df: DataFrame, ident: str, group: str, vector: str) -> DataFrame:
    """``(ident, group, cosine)``: similarity of each vector to its group's mean."""
    j = df.join(mean_vectors(df, group, vector), group)
    return j.select(ident, group, (1 - cosine_distance(F.col(vector), F.col("mean"))).alias("cosine"))


def medoids(df: DataFrame, ident: str, group: str, vector: str, digits: int = 9) -> DataFrame:
    """``(group, representative, cosine)``: the member most similar to the mean, ties to the smaller id."""
    c = cosine_to_mean(df, ident, group, vector)
    best = c.groupBy(group).agg(F.max(F.struct(F.round("cosine", digits).alias("cosine"), (-F.col(ident)).alias("m"))).alias("b"))
    return best.select(group, (-F.col("b.m")).alias("representative"), F.col("b.cosine").alias("cosine"))


def _block_pairs(df: DataFrame, ident: str, vector: str, by: str | None, block_rows: int) -> tuple[DataFrame, list[str]]:
    """Every row beside every block of its group: once as asking (q), once as answering; tasks are pairs of blocks."""
    src = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(by) if by else F.lit(0)).alias("grp")).filter("id is not null and v is not null and grp is not null")
    size = src.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    src = src.join(size, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = src.select("id", "v", "grp", F.col("block").alias("qb"), F.col("other").alias("rb"), F.lit(True).alias("q"))
    return asked.unionByName(src.select("id", "v", "grp", F.col("other").alias("qb"), F.col("block").alias("rb"), F.lit(False).alias("q"))), ["grp", "qb", "rb"]


def _distances(pdf: pd.DataFrame, digits: int):
    """Squared distances between the asking and the answering rows of a task, some hundred asking rows at a time."""
    a, b = pdf[pdf["q"]].sort_values("id"), pdf[~pdf["q"]].sort_values("id")
    if not len(a) or not len(b):
        return
    x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
    ids, refs = a["id"].to_numpy(), b["id"].to_numpy()
    for s in range(0, len(x), 512):
        part = x[s : s + 512]
        d = np.maximum((part**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * part @ y.T, 0).round(digits)
        yield ids[s : s + 512], refs, d


def knn(df: DataFrame, ident: str, vector: str, k: int, by: str | None = None, block_rows: int = 4096, digits: int = 9) -> DataFrame:
    """``(src, dst, d2, rank)``: exact k nearest (within the group ``by``) by squared distance, ties (after rounding) to the smaller id.

    Up to three dimensions rows are looked up in trees (``space.knn``). Beyond, rows are put into blocks by a hash; a task multiplies two blocks, and the best of each pair of
    blocks are merged. No task holds more than two blocks, but the work is quadratic: this is for groups of some hundred thousand vectors.
    """
    own = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), (F.col(by) if by else F.lit(0)).alias("grp")).filter("id is not null and v is not null and grp is not null")
    shape = own.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if shape[0] == shape[1] and shape[0] in (1, 2, 3):
        fine = own.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        return space.knn(fine, shape[0], k, 4 * block_rows, digits)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, refs, d in _distances(pdf, digits):
            d[ids[:, None] == refs[None, :]] = np.inf
            m = min(k, len(refs))
            near = np.argsort(d, axis=1, kind="stable")[:, :m]
            dist = np.take_along_axis(d, near, 1)
            ok = np.isfinite(dist)
            out.append(pd.DataFrame({"src": np.repeat(ids, m)[ok.ravel()], "dst": refs[near][ok], "d2": dist[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "d2": []}).astype({"src": "int64", "dst": "int64", "d2": float})

    from pyspark.sql import Window

    rows, keys = _block_pairs(df, ident, vector, by, block_rows)
    found = rows.groupBy(*keys).applyInPandas(run, "src long, dst long, d2 double")
    w = Window.partitionBy("src").orderBy("d2", "dst")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mutual_pairs(near: DataFrame) -> DataFrame:
    """``(src, dst)``, src < dst: pairs that are among each other's nearest; the neighbours are looked through once."""
    pairs = near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n"))
    return pairs.filter("n = 2").select("src", "dst")


def closest_pairs(df: DataFrame, ident: str, vector: str, density: float, block_rows: int = 4096, digits: int = 9) -> DataFrame:
    """``(i, j, d2)``, i < j: the closest pairs, as many as ``density`` times all pairs; each pair of blocks sends its closest only."""
    n = df.filter(F.col(vector).isNotNull()).count()
    want = int(np.floor(density * n * (n - 1) / 2 + 0.5))
    if want < 1:
        return df.select(F.col(ident).cast("long").alias("i"), F.col(ident).cast("long").alias("j"), F.lit(0.0).alias("d2")).limit(0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pd.DataFrame({"i": [], "j": [], "d2": []}).astype({"i": "int64", "j": "int64", "d2": float})
        for ids, refs, d in _distances(pdf, digits):
            a, b = np.nonzero(ids[:, None] < refs[None, :])
            part = pd.DataFrame({"i": ids[a], "j": refs[b], "d2": d[a, b]})
            best = pd.concat([best, part]).sort_values(["d2", "i", "j"]).head(want)
        return best

    rows, keys = _block_pairs(df, ident, vector, None, block_rows)
    return rows.groupBy(*keys).applyInPandas(run, "i long, j long, d2 double").orderBy("d2", "i", "j").limit(want)


def pca(df: DataFrame, ident: str, vector: str, components: int) -> tuple[DataFrame, list[float]]:
    """``(ident, vec)`` projected on the components of the centred vectors, and the variance explained; the largest loading of each is positive."""
    src = df.select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    size = len(df.select(vector).first()[0])
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(src).transform(src)
    model = PCA(k=min(components, size), inputCol="centred", outputCol="pc").fit(centred)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    signs = F.array(*(F.lit(float(s) or 1.0) for s in sign))
    out = model.transform(centred).select(ident, F.zip_with(vector_to_array("pc"), signs, lambda a, b: a * b).alias("vec"))
    return out, [float(v) for v in model.explainedVariance]


def kmeans(df: DataFrame, ident: str, vector: str, k: int, seed: int = 1, max_iter: int = 100, restarts: int = 5) -> DataFrame:
    """``(ident, cluster)``, clusters numbered by their smallest member; of ``restarts`` fits from different seeds that with the least sum of squares (ties: the first)."""
    src = df.select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).persist()
    fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter).fit(src) for i in range(restarts)]
    raw = min(fits, key=lambda m: m.summary.trainingCost).transform(src).select(ident, F.col("prediction").alias("p"))
    from pyspark.sql import Window

    first = raw.groupBy("p").agg(F.min(ident).alias("f"))  # k rows
    named = first.select("p", (F.row_number().over(Window.orderBy("f")) - 1).alias("cluster"))
    return raw.join(named, "p").select(ident, "cluster")
