"""Sources, projects, workflow and streams."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.functions.rng import generator
from papyrine.operators import export
from papyrine.plans.workflow import Queue, Task, Tree, next_steps, order, run_graph
from papyrine.sources import corpus, importers, mixture, npy, registry
from papyrine.streaming import live


def test_generator_repeats():
    a, b = generator(42), generator(42)
    x = [a() for _ in range(1000)]
    assert x == [b() for _ in range(1000)] and 0 <= min(x) < 0.02 and 0.98 < max(x) < 1


def test_mixture(spark):
    nodes, origins = mixture.mixture(spark, nodes=50, origins=6)
    assert nodes.count() == 50 and origins.count() == 6 and nodes.select("origin_id").distinct().count() == 6
    assert registry.read(spark, "toy", nodes=7, origins=2)["nodes"].count() == 7
    with pytest.raises(KeyError):
        registry.get("no such")


def test_npy(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = npy.read_npy(spark, str(tmp_path / "m.npy")).orderBy("row_no").collect()
    assert [r["vec"] for r in got] == m.tolist()
    np.save(tmp_path / "bad.npy", m.astype("<f8"))
    with pytest.raises(ValueError, match="<f4"):
        npy.header((tmp_path / "bad.npy").read_bytes())


def test_json_importer_and_first_wins(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"edges": [[1, 2], [2, 1], [3, 3]]}')
    assert importers.get_importer("json")(spark, {"path": str(tmp_path / "e.json")}).count() == 3
    rows = [(1, 2, "2020-01-02", "2020-01-03"), (2, 1, "2020-01-01", "2020-01-05"), (3, 3, "2020-01-01", "2020-01-01"), (4, None, "2020-01-01", "2020-01-01")]
    c = spark.createDataFrame(rows, "citing_id long, cited_id long, discovered string, arrived_at string")
    assert [tuple(r) for r in importers.materialise(c).collect()] == [(2, 1)]


def test_corpus_rules(spark):
    p = spark.createDataFrame([(1, 0, 0, "a", "b"), (2, 0, 1, "a", None), (3, 1, 0, "a", "b"), (4, 0, 0, None, "b"), (5, 0, 0, "t", None)], "paper_id long, is_rejected int, is_stub int, title string, abstract string")
    ids = lambda d: sorted(r["paper_id"] for r in d.collect())
    assert ids(corpus.embedded(p)) == [1] and ids(corpus.ghosts(p)) == [2, 5]
    assert corpus.check_snapshot("/x/corpus-snapshot-1.db")
    with pytest.raises(ValueError):
        corpus.check_snapshot("/snapshot/live.db")
    want = spark.createDataFrame([(0, 9)], "position long, paper_id long")
    with pytest.raises(ValueError):
        corpus.subset(p, want)
    t = spark.createDataFrame([("A", "B"), (None, "B"), ("A", " ")], "t string, a string").select(corpus.record_text(F.col("t"), F.col("a")))
    assert [r[0] for r in t.collect()] == ["A. B", "B", "A"]
    a = spark.createDataFrame([('["x", " ", "y"]',), ("x; y;",), (None,), ("[broken",)], "a string").select(corpus.author_list(F.col("a")))
    assert [r[0] for r in a.collect()] == [["x", "y"], ["x", "y"], [], []]


def test_project_round_trip(spark, tmp_path):
    df = spark.range(5)
    export.save_project(spark, str(tmp_path / "p"), {"nodes": df}, {"k": 3})
    tables, settings = export.load_project(spark, str(tmp_path / "p"))
    assert tables["nodes"].count() == 5 and settings == {"k": 3}
    spark.createDataFrame([('{"schema_version": 99, "tables": []}',)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "p/manifest"))
    with pytest.raises(ValueError):
        export.load_project(spark, str(tmp_path / "p"))


def test_graph_order_and_failure():
    seen = []
    tasks = {"c": Task(lambda d: d["a"] + d["b"], ("a", "b")), "a": Task(lambda d: 1), "b": Task(lambda d: 2), "off": Task(lambda d: seen.append(1), (), False)}
    assert run_graph(tasks) == {"a": 1, "b": 2, "c": 3, "off": None} and not seen
    assert order(tasks).index("c") > order(tasks).index("a")
    with pytest.raises(ValueError):
        order({"a": Task(None, ("b",)), "b": Task(None, ("a",))})
    with pytest.raises(KeyError):
        order({"a": Task(None, ("x",))})
    with pytest.raises(ZeroDivisionError):
        run_graph({"a": Task(lambda d: 1 / 0), "b": Task(lambda d: 1, ("a",))})
    stop = threading.Event()
    stop.set()
    with pytest.raises(InterruptedError):
        run_graph({"a": Task(lambda d: 1)}, cancelled=stop)


def test_queue_and_tree():
    t = Tree()
    src = t.create("source")
    cl = t.create("clustering", parent=src.id)
    q = Queue(t)
    q.add("read", lambda p: "rows", src.id)
    bad = q.add("bad", lambda p: 1 / 0)
    late = q.add("late", lambda p: None)
    q.add("cluster", lambda p: "labels", cl.id)
    assert q.cancel(late.number)
    q.run_all()
    assert [j.status for j in q.jobs] == ["done", "failed", "cancelled", "done"] and "division" in bad.error
    assert not t.is_stale(cl.id) and "bridges" in next_steps(t, cl.id)
    t.set_result(src.id, "new rows")
    assert t.is_stale(cl.id) and next_steps(t, cl.id) == ()
    assert t.nearest(cl.id, "source").result == "new rows" and t.inputs(cl.id)["source"] == "new rows"
    assert sorted(t.delete(src.id)) == [src.id, cl.id] and not t.steps


def test_stream_of_assignments(spark, tmp_path, small):
    raw = spark.read.parquet(f"{small}/cluster_nodes.parquet")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write = live.upsert_batches(str(tmp_path / "out"), ["level_uid", "node_id"])
    q = live.current_assignments(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    from papyrine.sources import snapshot

    last = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name[1:]))[-1]
    got = spark.read.parquet(str(last)).select("level_uid", "node_id", "node_cluster")
    want = snapshot.assignments(raw).select("level_uid", "node_id", "node_cluster")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_of_citations(spark, tmp_path, small):
    raw = spark.read.parquet(f"{small}/citations.parquet")
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    q = live.citation_rate(stream).writeStream.outputMode("append").format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from rate").first()[0] > 0
