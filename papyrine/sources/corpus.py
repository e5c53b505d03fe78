"""Corpora: papers, their vectors and citations, and the subsets of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import strip


def normalised_time(nodes: DataFrame, newest: float = 0.0) -> DataFrame:
    """``t`` in [0, 1] from ``year``, the newest year at ``newest``; unknown years at the other end."""
    span = nodes.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))  # one row
    share = F.when(F.col("hi") > F.col("lo"), (F.col("year") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    share = F.when(F.col("year").isNull(), 0.0).otherwise(share)
    return nodes.drop("t").crossJoin(F.broadcast(span)).withColumn("t", share if newest >= 0.5 else 1 - share).drop("lo", "hi")


def embedded(papers: DataFrame) -> DataFrame:
    """Papers with a title and an abstract, neither rejected nor stubs."""
    return papers.filter("is_rejected = 0 and is_stub = 0 and title is not null and abstract is not null")


def ghosts(papers: DataFrame) -> DataFrame:
    """Papers with a title that lack an abstract or are stubs."""
    return papers.filter("is_rejected = 0 and title is not null and (is_stub = 1 or abstract is null)")


def drift(index: DataFrame, papers: DataFrame, key: str = "paper_id") -> DataFrame:
    """``(paper_id, side)``: papers that only one of index and table has; must be empty before vectors are joined by row."""
    a, b = index.select(key, F.lit(True).alias("in_index")), papers.select(key, F.lit(True).alias("in_table"))
    j = a.join(b, key, "full").filter("in_index is null or in_table is null")
    return j.select(key, F.when(F.col("in_index").isNull(), "table").otherwise("index").alias("side"))


def subset(papers: DataFrame, wanted: DataFrame, key: str = "paper_id") -> DataFrame:
    """Papers of a subset ``(position, paper_id)`` in its order, numbered from 0; raises if one is missing."""
    missing = wanted.join(papers, key, "left_anti")
    if not missing.isEmpty():
        raise ValueError(f"{missing.count()} papers of the subset aren't in the corpus")
    return papers.join(wanted.select(key, F.col("position").alias("node_id")), key)


def assemble(index: DataFrame, papers: DataFrame, citations: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Nodes (node_id, paper_id, year, t, is_ghost), edges (src, dst), vectors (node_id, vec) and the number of citations left out, of a corpus.

    ``index``: (row_no, paper_id), the rows of the matrix ``vectors`` (row_no, vec). Raises if index and embedded papers differ. Embedded nodes are numbered by their row, ghosts after
    them by ``paper_id``; a citation with an end that is neither is left out and counted.
    """
    from papyrine.operators.numbering import numbered
    from papyrine.session import cut

    whole = embedded(papers)
    lost = drift(index, whole).groupBy("side").count().collect()  # two rows at most
    if lost:
        raise ValueError("index and papers differ: " + ", ".join(f"{r['count']} only in the {r['side']}" for r in sorted(lost)))
    real = index.join(whole, "paper_id").select(F.col("row_no").cast("long").alias("node_id"), "paper_id", "year", F.lit(False).alias("is_ghost"))
    n = real.count()
    late = numbered(ghosts(papers).select("paper_id", "year"), "paper_id", "r").select((F.col("r") + n).alias("node_id"), "paper_id", "year", F.lit(True).alias("is_ghost"))
    nodes = cut(normalised_time(real.unionByName(late)))
    ends = nodes.select("paper_id", "node_id")
    all_ = citations.filter("citing_id is not null and cited_id is not null and citing_id <> cited_id").select("citing_id", "cited_id").distinct()
    kept = cut(all_.join(ends.toDF("citing_id", "src"), "citing_id").join(ends.toDF("cited_id", "dst"), "cited_id").select("src", "dst"))
    out = {"nodes": nodes, "edges": kept, "dropped": all_.agg(F.count("*").alias("n")).select((F.col("n") - kept.count()).alias("dropped"))}
    return out | ({"vectors": vectors.select(F.col("row_no").cast("long").alias("node_id"), "vec")} if vectors is not None else {})


def discover(spark: SparkSession, root: str) -> list[str]:
    """Names ``project::subset`` of the directories below ``root`` that hold an index, each once."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    found = set()
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root + "/*/*/index.json")) or []:
        part = s.getPath().toString().split("/")
        found.add(f"{part[-3]}::{part[-2]}")
    return sorted(found)


def check_snapshot(path: str) -> str:
    """The path, if its name says that it is a snapshot; a live database must not be read."""
    if not re.search("snapshot", path.rsplit("/", 1)[-1]):
        raise ValueError(f"{path} isn't a snapshot")
    return path


def record_text(title, abstract):
    """Title and abstract, as far as present, joined by ". "."""
    part = lambda c: F.when(strip(c) != "", strip(c))
    return F.concat_ws(". ", part(title), part(abstract))


def author_list(authors):
    """Names of a JSON array of strings, or of a text separated by semicolons; blanks left out, [] if there are none."""
    listed = F.when(F.trim(authors).startswith("["), F.from_json(authors, "array<string>")).otherwise(F.split(authors, ";"))
    return F.coalesce(F.filter(F.transform(listed, strip), lambda a: a.isNotNull() & (a != "")), F.array().cast("array<string>"))


def stage_input(embeddings: DataFrame | None, positions: DataFrame | None) -> tuple[str, DataFrame] | None:
    """What the reduction begins with: the vectors, else the positions, else nothing."""
    if embeddings is not None:
        return "embedding", embeddings
    if positions is not None:
        return "base_pos", positions.select("node_id", F.array("x", "y", "z").alias("vec"))
    return None
