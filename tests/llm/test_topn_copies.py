import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.llm import exact_copies, topn


def top(spark, rows, n, schema="g string, score double, id long"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return [tuple(r) for r in topn.top_n(df, ["g"], "score", "id", n).collect()]


def brute(rows, n):
    nan = lambda s: s is not None and s != s
    key = lambda r: (r[1] is None, 0 if nan(r[1]) else 1, 0 if r[1] is None or nan(r[1]) else -r[1], r[2] is None, r[2] or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return [r for g in groups.values() for r in sorted(g, key=key)[:n]]


value = st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.5, -2.0, float("nan")]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None, ""]), value, st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=40), n=st.integers(1, 4))
def test_top_n_against_sorting(spark, rows, n):
    text = lambda rs: sorted(map(str, rs))
    assert text(top(spark, rows, n)) == text(brute(rows, n))


def test_top_n_ties_repeats_and_hot_group(spark):
    rows = [("hot", float(i % 7), i) for i in range(5000)] + [("cold", 1.0, 3), ("cold", 1.0, 3), ("cold", 1.0, 2)]
    got = top(spark, rows, 3)
    assert sorted(r for r in got if r[0] == "hot") == [("hot", 6.0, 6), ("hot", 6.0, 13), ("hot", 6.0, 20)]
    assert sorted(r for r in got if r[0] == "cold") == [("cold", 1.0, 2), ("cold", 1.0, 3), ("cold", 1.0, 3)]


def test_top_n_empty_extra_and_clashing_columns(spark):
    schema = "g string, score double, id long, rank int, row_number string, t timestamp, deep array<int>"
    assert topn.top_n(spark.createDataFrame([], schema), ["g"], "score", "id", 2).count() == 0
    df = spark.createDataFrame([("a", 1.0, 1, 9, "x" * 100_000, dt.datetime(2020, 1, 1), [1]), ("a", 2.0, 2, 8, None, None, None)], schema)
    got = topn.top_n(df, ["g"], "score", "id", 1).collect()
    assert [(r["id"], r["rank"]) for r in got] == [(2, 8)] and got[0].__fields__ == df.columns
    assert topn.top_n(df, ["g"], "score", "id", 0).count() == 0
    twice = df.select("*", F.lit("other").alias("G"), F.lit(7.0).alias("score"))  # exact names count, the first of equal ones
    assert [r[2] for r in topn.top_n(twice, ["g"], "score", "id", 1).collect()] == [2] and topn.top_n(twice, ["g"], "score", "id", 1).columns == twice.columns


def canon(s):
    return "".join(c for c in s.casefold() if c.isalnum())


def test_copies_against_brute_force(spark):
    rows = [
        (1, "Straße, one", "10.1/X"), (2, "STRASSE ONE", "101x"), (3, "10.1/x", "Strasse one"), (4, "Straße one", None), (5, "straße—one", " -- "), (6, None, "10.1/X"),
        (7, None, "10.1/X"), (8, "", "a"), (9, "--", "A!"), (10, "a", None), (11, "x" * 200_000, "é"), (12, "X" * 200_000, "É"), (13, "other", "10.1/x"), (13, "other", "10.1/x"),
    ]
    df = spark.createDataFrame([(*r, "noise") for r in rows], "row_id long, title string, doi string, key string")
    groups = {}
    for i, t, d in rows:
        if t is not None:
            groups.setdefault(tuple(sorted((canon(t), canon(d or "")))), []).append(i)
    df = df.select("*", F.lit("x").alias("TITLE"), F.lit(0).alias("id"))
    enc = exact_copies.encode(df, "row_id", ["title", "doi"], ["title"])
    assert sorted(map(tuple, exact_copies.copies(enc).collect())) == sorted((min(g), i) for g in groups.values() for i in set(g) if i > min(g))
    assert sorted(map(tuple, exact_copies.records(enc).collect())) == sorted((min(g), len(g)) for g in groups.values())


def test_copies_in_field_order(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "B", "A"), (3, "A.", "b")], "row_id long, title string, doi string")
    assert [tuple(r) for r in exact_copies.copies(exact_copies.encode(df, "row_id", ["title", "doi"], ordered=True)).collect()] == [(1, 3)]


def test_copies_of_nothing(spark):
    enc = exact_copies.encode(spark.createDataFrame([], "row_id long, title string, doi string"), "row_id", ["title", "doi"], ["title"])
    assert exact_copies.copies(enc).count() == 0 and exact_copies.records(enc).count() == 0


def test_copies_of_hot_values(spark):
    """A title a third of all rows share, and a record that holds many of them."""
    rows = [(i, "The Same  Title" if i % 3 == 0 else f"title {i}", "10/x" if i % 6 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, title string, doi string")
    enc = exact_copies.encode(df, "row_id", ["title", "doi"], required=["title"])
    got = {tuple(r) for r in exact_copies.copies(enc).collect()}
    assert got == {(0, i) for i in range(6, 3000, 6)} | {(3, i) for i in range(9, 3000, 6)}
