import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.llm import language, mixing, packing, tokens
from papyrine.llm.byte_cnn import ByteCnn


def test_token_counts(spark):
    enc = tokens.encoding()
    texts = ["", None, "Hello world", "été " * 5000, "a" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r["id"]: r["tokens"] for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]


def check_packing(placed, items, bins):
    df = placed.toPandas()
    for name, cap in bins:
        d = df[df.bin_name == name]
        assert d.groupby("item").tokens.sum().to_dict() == {i: s for i, s in items}
        load = d.groupby("container").tokens.sum()
        assert (load <= cap).all()
        for _, c in d.groupby("container"):
            c = c.sort_values("place")
            assert c.place.tolist() == list(range(len(c))) and c.offset.tolist() == [0, *c.tokens.cumsum().tolist()[:-1]]
        for i, s in items:
            p = d[d.item == i].sort_values("piece")
            assert len(p) == max(1, -(-s // cap)) and p.start.tolist() == [k * cap for k in range(len(p))]


@pytest.mark.parametrize(("windows", "rows", "merge"), [(64, 20_000, 20_000), (3, 40, 30)])
def test_packing(spark, windows, rows, merge):
    rng = np.random.default_rng(0)
    items = [(i, int(s)) for i, s in enumerate(rng.integers(0, 130, 400))] + [(1000, 1000), (1001, 0), (1002, 100), (1003, 300)]
    bins = [("s", 100), ("l", 400)]
    df = spark.createDataFrame([(*x, "y") for x in items], "id long, tokens long, container string")
    placed = packing.pack(df, bins, windows, rows, merge)
    check_packing(placed, items, bins)
    fill = {r["bin_name"]: r for r in packing.usage(placed, spark.createDataFrame(bins, "bin_name string, capacity_tokens int")).collect()}
    assert fill["l"]["fill"] > 0.9 and fill["s"]["containers"] >= fill["s"]["least"]


def test_packing_a_repeated_item(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 25), (2, 4)], "id long, tokens long")
    got = packing.pack(df, [("b", 10)]).collect()
    loads = {}
    for r in got:
        loads[r["container"]] = loads.get(r["container"], 0) + r["tokens"]
    assert sorted(loads.values()) == [9, 10, 10, 10, 10]


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 3), (2, None), (3, -1)], "id long, tokens long")
    got = packing.pack(df, [("a", 10), ("a", 7), ("b", 0), (None, 5), ("c", None)]).collect()
    assert sorted((r["bin_name"], r["item"], r["tokens"]) for r in got) == [("a", 1, 5), ("a", 1, 5)]
    assert packing.pack(df.limit(0), [("a", 10)]).count() == 0


def test_mixing(spark):
    rng = np.random.default_rng(1)
    docs = [(i, "big", int(t)) for i, t in enumerate(rng.integers(50, 150, 3000))] + [(5000 + i, "small", 100) for i in range(40)] + [(9000, None, 10), (None, "big", 10), (9001, "other", None)]
    targets = [("m", "big", 0.5, 1), ("m", "small", 0.3, 4), ("m", "gone", 0.2, 2), ("n", "big", 0.25, 3), ("n", "small", 0.75, None), (None, "big", 0.5, 1)]
    d = spark.createDataFrame(docs, "id long, source string, tokens long")
    t = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(d, t, budget=100_000)
    r = {(x["mix_name"], x["source"]): x for x in report.collect()}
    assert abs(r["m", "big"]["tokens"] - 50_000) < 150
    assert r["m", "small"]["tokens"] == 16_000 and r["m", "small"]["most_copies"] == 4 and r["m", "gone"]["tokens"] == 0
    assert r["n", "small"]["tokens"] == 0 and abs(r["n", "big"]["tokens"] - 25_000) < 150
    c = chosen.toPandas()
    assert (c[(c.mix_name == "m") & (c.source == "big")].copies == 1).all() and c.duplicated(["mix_name", "id"]).sum() == 0
    for (m, s), x in r.items():
        p = c[(c.mix_name == m) & (c.source == s)]
        assert (p.tokens * p.copies).sum() == x["tokens"]
    assert sum(x["share_reached"] for k, x in r.items() if k[0] == "m") == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("bucket", [4096, 30])
def test_mixing_meets_shares(spark, bucket):
    """A source that is short bounds the budget, so that all shares are met; with all tokens it can't."""
    rng = np.random.default_rng(7)
    docs = [(i, "abc"[0 if i < 3000 else 1 if i < 3400 else 2], int(x)) for i, x in enumerate(rng.integers(1, 200, 3600))]
    d = spark.createDataFrame(docs, "id long, source string, tokens long")
    t = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "b", 0.3, 2), ("m", "c", 0.4, 3), ("m", "void", 0.2, 2), ("m", "never", 0.1, 0)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(d, t, ("match", "all"), bucket_rows=bucket)
    r = {(x["budget"], x["source"]): x for x in report.collect()}
    for s, want in (("a", 0.3), ("b", 0.3), ("c", 0.4)):
        assert r["match", s]["share_reached"] == pytest.approx(want, abs=0.003)
    assert r["match", "c"]["most_copies"] == 3 and r["all", "c"]["share_reached"] < 0.3 and r["match", "void"]["tokens"] == 0
    c = chosen.filter("budget = 'match'").toPandas()
    assert not c.duplicated("id").any() and (c.tokens * c.copies).sum() == sum(r["match", s]["tokens"] for s in "abc")


def test_fill():
    assert mixing.fill(np.array([5, 5, 5]), 10).tolist() == [True, True, False]
    assert mixing.fill(np.array([7, 9, 2, 1]), 10).tolist() == [True, False, True, True]
    assert mixing.fill(np.array([3, 8]), 10).tolist() == [True, False] or mixing.fill(np.array([3, 8]), 10).tolist() == [True, True]
    assert mixing.fill(np.array([11]), 10).tolist() == [True] and mixing.fill(np.array([30]), 10).tolist() == [False] and mixing.fill(np.array([], dtype=int), 4).tolist() == []


def test_mixing_fills_gaps_and_empty_tables(spark):
    d = spark.createDataFrame([(i, "a", 1000 if i % 5 == 0 else 7) for i in range(200)], "id long, source string, tokens long")
    t = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    _, report = mixing.mix(d, t, budget=5600)
    assert abs(report.first()["tokens"] - 5600) <= 600
    chosen, report = mixing.mix(d, t, budget=5600, bucket_rows=20)
    assert abs(report.first()["tokens"] - 5600) <= 1000
    chosen, report = mixing.mix(d.limit(0), t)
    assert chosen.count() == 0 and report.first()["tokens"] == 0
    assert mixing.mix(d, t.limit(0))[0].count() == 0


TEXTS = {
    "de": "der hund läuft über die straße und die katze schläft nicht weil das haus groß ist ",
    "en": "the dog runs over the street and the cat does not sleep because the house is large ",
    "fr": "le chien court dans la rue et le chat ne dort pas parce que la maison est grande ",
    "es": "el perro corre por la calle y el gato no duerme porque la casa es muy grande ",
}


@pytest.fixture(scope="module")
def trained(spark):
    samples = spark.createDataFrame([(k, i, v * 6) for k, v in TEXTS.items() for i in range(3)], "lang string, sample_no int, text string")
    docs = spark.createDataFrame([(i, "\n".join([v[:60]] * 5), k) for i, (k, v) in enumerate(TEXTS.items())], "doc_id long, text string, lang string")
    return language.train(samples, docs)


def test_gradients():
    net = ByteCnn(["a", "b"], widths=(2, 3), filters=4)
    texts = [b"abcabc", b"xyzxyz", b"abxy", b"zzz"] * 60
    net.train(texts, np.array([0, 1, 0, 1] * 60), epochs=12, batch=16, dropout=0.0, rate=0.01, least_steps=100)
    lp = net.log_probs(texts)
    assert (lp.argmax(1) == np.array([0, 1, 0, 1] * 60)).all() and np.allclose(np.exp(net.log_probs([b"abc"])).sum(), 1, atol=1e-5)


@settings(max_examples=40, deadline=None)
@given(lines=st.lists(st.text(st.characters(blacklist_characters="\n", blacklist_categories=["Cs"]), max_size=16), min_size=1, max_size=6))
def test_lines_by_place_equal_lines_alone(lines):
    net = ByteCnn(["a", "b", "c"], filters=8)
    data = [x.encode() for x in lines]
    lp, n = net.line_log_probs(b"\n".join(data), net.tables())
    assert n.tolist() == [len(x) for x in data] and np.allclose(lp, net.log_probs(data), atol=1e-3)


def test_labels_in_other_notation(spark):
    rows = ["de", "DE", "deu", "ger", "German", "de-AT", " de ", "fr_CA", "", "und", "unknown", None, "ru"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "l string").select(language.label_language(F.col("l"))).collect()]
    assert got == ["de"] * 7 + ["fr", None, None, None, None, "ru"]


def test_pages_and_passages(spark, trained):
    de, en = ([v[i : i + 40] for i in (0, 20, 35)] for v in (TEXTS["de"], TEXTS["en"]))
    mixed = de * 4 + en + ["30,82 —"] + de * 3
    docs = [(1, "\n".join(de * 3), "en"), (2, "\n".join(de * 3), "DEU"), (3, "\n".join(mixed), None), (4, "", None), (5, None, "de"), (6, "12\n--", "und"), (7, "\n".join(en * 4000), "unknown")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, main string")
    got = {tuple(r) for r in language.cases(language.detect(df, trained)).collect()}
    assert {(1, 0, "de"), (3, 0, "de"), (7, 0, "en")} <= got and not {r for r in got if r[0] in (2, 4, 5, 6)}
    assert {r for r in got if r[0] == 3 and r[1]} == {(3, i, "en") for i in (13, 14, 15)}
    seg = [tuple(r)[:4] for r in language.segments(language.detect(df, trained)).filter("doc_id = 3").orderBy("first_line").collect()]
    assert seg == [(3, None, None, "de"), (3, 13, 15, "en")]
    assert language.cases(language.detect(df.limit(0), trained)).count() == 0


@pytest.mark.parametrize("size", [100, 300, 1000, 2500])
def test_one_line_adverts_on_long_pages(size):
    """A sure line in another language is found however long the page; a doubtful one brings no language in."""
    rng = np.random.default_rng(size)
    lp = np.full((size, 7), -9.0) + rng.normal(size=(size, 7))
    lp[:, 0] = -0.01
    letters, doc, at = np.full(size, 30.0), np.zeros(size, dtype=int), size // 3
    lp[at] = [-8, -8, -8, -8, -8, -0.01, -8]
    lp[at + 20 :: 40, 2] = -0.5  # doubtful lines, each a bit likelier in a third language
    lp[at + 20 :: 40, 0] = -1.0
    r, main = language.smooth(lp, letters, doc)
    assert main.tolist() == [0] and np.flatnonzero(r.argmax(1) != 0).tolist() == [at] and r[at].argmax() == 5


def test_held_out_lines(spark):
    """Trained on sf0.01, a network tells the lines of other documents, whose labels are a tenth wrong."""
    from papyrine.session import table

    d = "/root/testdata/sf0.01"
    net = language.train(table(spark, d, "lang_samples"), table(spark, d, "documents"))
    other = table(spark, "/root/testdata/sf0.1", "documents").filter(F.col("lang").isin(language.LANGUAGES)).limit(400)
    got = language.detect(other, net)
    assert got.agg(F.avg((F.col("main") == F.col("label")).cast("int"))).first()[0] > 0.8


def test_network_is_kept(spark, small):
    samples, documents = spark.read.parquet(f"{small}/lang_samples.parquet"), spark.read.parquet(f"{small}/documents.parquet")
    state = language.state_of(spark, f"{small}/lang_samples.parquet", f"{small}/documents.parquet")
    assert state == language.state_of(spark, f"{small}/lang_samples.parquet", f"{small}/documents.parquet") != language.state_of(spark, f"{small}/documents.parquet")
    a = language.trained(samples, documents, state, train_docs=20, epochs=1)
    b = language.trained(samples.limit(0), documents.limit(0), state, train_docs=20, epochs=1)  # loaded
    texts = [b"das ist ein Satz", b"this is one", b""]
    assert np.allclose(a.log_probs(texts), b.log_probs(texts)) and b.labels == language.LANGUAGES
    assert ByteCnn.from_bytes(a.to_bytes()).widths == a.widths


def test_samples_of_every_language_count(spark):
    """More samples than the bound: each language keeps its share of it."""
    rows = [(lang, i, f"text {lang} {i}") for lang in language.LANGUAGES for i in range(30)]
    seen = []
    keep, ByteCnn.train = ByteCnn.train, lambda self, texts, y, **k: seen.append(np.bincount(y, minlength=7))
    try:
        language.train(spark.createDataFrame(rows, "lang string, sample_no int, text string"), spark.createDataFrame([], "doc_id long, text string, lang string"), train_docs=70)
    finally:
        ByteCnn.train = keep
    assert (seen[0] == 30).all()  # ten samples of each, at three rates of misreading
