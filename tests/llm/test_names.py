import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import names, trie


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


words = st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=25, unique=True)


@settings(max_examples=200, deadline=None)
@given(ws=words)
def test_shard_pairs_against_edit_distance(ws):
    got = trie.shard_pairs(sorted(ws))
    assert sorted(got) == [(a, b) for a, b in itertools.combinations(sorted(ws), 2) if osa(a, b) <= 1]


def test_near_pairs_lose_nothing(spark):
    import random

    rng = random.Random(3)
    ws = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(500)})
    df = spark.createDataFrame([(w, 1) for w in [*ws, *ws[:5], "", None]], "w string, a int")
    got = sorted(map(tuple, trie.near_pairs(df, "w").collect()))
    assert got == [(a, b) for a, b in itertools.combinations(ws, 2) if osa(a, b) <= 1]


def test_near_pairs_two_edits(spark):
    import random

    rng = random.Random(5)
    ws = {"".join(rng.choice("abc") for _ in range(rng.randint(7, 14))) for _ in range(120)}
    for w in sorted(ws):  # neighbours at one to three edits
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(x) - 1)
                k = rng.randrange(4)
                if k == 0:
                    x[i] = rng.choice("abc")
                elif k == 1:
                    x.insert(i, rng.choice("abc"))
                elif k == 2 and len(x) > 4:
                    del x[i]
                else:
                    x[i], x[i + 1] = x[i + 1], x[i]
            ws.add("".join(x))
    ws = sorted(ws)
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    got = sorted(map(tuple, trie.near_pairs(df, "w", edits=2, long=9).collect()))
    assert got == [(a, b) for a, b in itertools.combinations(ws, 2) if osa(a, b) <= (2 if min(len(a), len(b)) >= 9 else 1)]


shorts = st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12, unique=True)


@settings(max_examples=200, deadline=None)
@given(a=shorts, b=shorts)
def test_shortened_against_all_pairs(a, b):
    got = sorted(p for p in trie.shortened(sorted(a), sorted(b)) if names.abbreviates(*p))
    assert got == sorted((x, y) for x in a for y in b if len(y) > len(x) and names.abbreviates(x, y))


def test_agree_in_any_order():
    assert names.agree(["j", "biol", "mol"], ["biology", "molecular", "journal"]) and not names.agree(["j", "j"], ["journal", "molecular"])
    assert names.agree(["co", "c"], ["computing", "cell"]) and names.agree(["c", "co"], ["computing", "cell"])
    many = ["c" * i for i in range(1, 40)]
    assert names.agree(many, many[::-1])  # no factorial of words with equal initials


def entities(spark, authors, venues=()):
    rows = [(a, None) for a in authors] + [(None, v) for v in venues]
    df = spark.createDataFrame(rows, "authors string, venue string")
    out = {}
    for r in names.variants(df).collect():
        out.setdefault((r["kind"], r["entity"]), set()).add(r["spelling"])
    return sorted(map(sorted, out.values()))


def test_persons(spark):
    a = ["Katherine Lunezezor", "Kathy Lunezezor", "Lunezezor, K.", "LUNEZEZOR, Katherine", "Katherine Luneezzor", "Dr. Katherine G. Lunezezor", "Kat. Lunezezor"]
    b = ["Bruno Lunezezor", "B. Lunezezor", "Lunezezor B"]
    c = ["Gösta Lolalunan", "Gosta Lolalunan", "Goesta Lolalunan", "Lolalunan Gösta"]
    fill = ["Gösta Rurisockan", "Katherine Dajizufen"]
    got = entities(spark, ["; ".join(a), "; ".join(b + c), "; ".join(fill), "et al.", "Bruno Lunezezor; et al", None, "", " ;; ", "123"])
    assert got == sorted([sorted(a), sorted(b), sorted(c), [fill[0]], [fill[1]]])


def test_unclear_initial_joins_nobody(spark):
    got = entities(spark, ["Lars Tumumarror; Leopold Tumumarror; L. Tumumarror; Tumumarror L"])
    assert sorted(map(len, got)) == [1, 1, 2]


def together(spark, *authors):
    got = entities(spark, ["; ".join(authors)])
    return [set(g) for g in got if len(g) > 1]


def test_what_is_unclear_is_not_joined(spark):
    assert together(spark, "Christian Meyer", "Ian Meyer", "Anna Weber", "Rosanna Weber", "John A. Smith", "John B. Smith") == []
    assert together(spark, "Chris Lang", "Christian Lang", "Christopher Lang") == []
    assert together(spark, "John A. Smith", "John Smith", "John B. Smith") == []
    assert together(spark, "John A. Smith", "John Smith", "Smith, J.", "Smith, J. A.", "Smith, J. B.") == [{"John A. Smith", "John Smith", "Smith, J.", "Smith, J. A."}]


def test_what_is_clear_is_joined(spark):
    assert together(spark, "Chris Lang", "Christian Lang") == [{"Chris Lang", "Christian Lang"}]
    assert together(spark, "Kath Meyer", "Kathy Meyer", "Katherine Meyer") == [{"Kath Meyer", "Kathy Meyer", "Katherine Meyer"}]
    assert together(spark, "Wei Ngai", "Wei Nagi", "Wei Ngao") == [{"Wei Ngai", "Wei Nagi"}]
    assert together(spark, "Jim Quillfeather", "James Quillfeather", "Quilfeather, James") == [{"Jim Quillfeather", "James Quillfeather", "Quilfeather, James"}]


def test_names_common_in_their_own_right(spark):
    """Mario and Maria, Paul and Paula are near, but common with different families; Soeren and Soren are spellings of one."""
    fam = [f"{a}{b}ensek" for a in ("Bra", "Klo", "Tru", "Wex", "Zil", "Hov") for b in ("dum", "gop", "rix")]
    rows = [f"Mario {f}" for f in fam[:8]] + [f"Maria {f}" for f in fam[8:16]] + ["Mario Zzyzx", "Maria Zzyzx", "Paul Zzyzx", "Paula Zzyzx"]
    rows += [f"Paul {f}" for f in fam[8:16]] + [f"Paula {f}" for f in fam[:8]] + [f"{g} {f}son" for g in ("Soeren", "Soren") for f in fam[:7]]
    got = together(spark, *rows)
    assert sorted(map(sorted, got)) == sorted(sorted([f"Soeren {f}son", f"Soren {f}son"]) for f in fam[:7])


def test_two_edits_if_asked_for(spark):
    rows = [("Anna Quillfeatherstone", 5), ("Anna Qillfeathersotne", 1), ("Anna Brook", 1)]
    df = spark.createDataFrame(rows, "spelling string, n long")
    for edits, n in ((1, 3), (2, 2)):
        assert names.persons(df, edits=edits).select("entity").distinct().count() == n


def test_venues_of_one_initial(spark):
    """One hot block: all names are one word with the same first letter."""
    v = [f"C{a}{b}ology" for a in ("ardi", "ryo", "hrono", "limat", "yto", "arto") for b in ("l", "n", "r")]
    got = entities(spark, [], [*v, "Chronol", "Climatnol", "C"])
    flat = [set(g) for g in got]
    assert {"Chronol", "Chronolology"} in flat and {"Climatnol", "Climatnology"} in flat and {"C"} in flat


def test_beginnings_go_before_letters_in_order(spark):
    v = ["Transactions on Lattice Linguistics", "Transactions on Lattice Limnology", "Trans. Latt. Ling.", "Trans. Latt. Lgy."]
    flat = [set(g) for g in entities(spark, [], v)]
    assert {v[0], v[2]} in flat and {v[1], v[3]} in flat


def test_venues(spark):
    a = ["Advances in Basalt Hydrology", "Adv. Basalt Hydr.", "Basalt Hydrology, Advances in", "ADVANCES IN BASALT HYDROLOGY", "Advances in Basalt Hydrology (ABH)", "A.B.H.", "Basalt Hydrology (Advances in)", "Adv.Basalt Hydr."]
    b = ["Annals of Basalt Hydrology", "Annals of Bsaalt Hydrology", "Ann Basalt Hydr"]
    w = ["Workshop on Computational Tidal Optics", "Wksp Comput Tidal Opt", "WCTO", "The Workshop on Computational Tidal Optics (Online)"]
    got = entities(spark, [], [*a[:-2], *a, *b, *w, *(["Annals of Basalt Hydrology"] * 6), None, "", "--"])
    flat = [set(g) for g in got]
    assert set(b) in flat and set(w) in flat
    assert set(a) - {"A.B.H."} <= next(g for g in flat if a[0] in g)
    assert sum(map(len, flat)) == len({*a, *b, *w})


def test_pairs_and_empty_tables(spark):
    df = spark.createDataFrame([("Ann Telbogor; ann telbogor; Telbogor, Ann", "x" * 50_000)], "authors string, venue string")
    got = [tuple(r) for r in names.pairs(names.variants(df)).collect()]
    assert sorted(got) == [("author", "Ann Telbogor", "Telbogor, Ann"), ("author", "Ann Telbogor", "ann telbogor"), ("author", "Telbogor, Ann", "ann telbogor")]
    assert names.pairs(names.variants(df.limit(0))).count() == 0


def test_short_forms_no_rule_covers(spark):
    pairs = [("James", "Jim"), ("John", "Jack"), ("Anthony", "Tony"), ("Stephen", "Steve"), ("Lawrence", "Larry"), ("Henry", "Harry"), ("Patrick", "Paddy"), ("Joseph", "Joey"), ("Rebecca", "Becky"), ("Sebastian", "Basti"), ("Matthias", "Matze"), ("Walter", "Wally")]
    known = {(full, short) for short, full in names.SHORT_FORMS}
    assert {(a.lower(), b.lower()) for a, b in pairs} <= known
    rows = [(f"{given} {family}", 2) for family, pair in (("Quillfeather", pairs[0]), ("Brandtmeyer", pairs[9])) for given in pair]
    entity = {r["spelling"]: r["entity"] for r in names.persons(spark.createDataFrame(rows, "spelling string, n long")).collect()}
    assert entity["James Quillfeather"] == entity["Jim Quillfeather"] and entity["Sebastian Brandtmeyer"] == entity["Basti Brandtmeyer"]


def test_plans_stay_small(spark, monkeypatch):
    """The driver plans a step anew after each of its stages: near words are worked out once, not once for each use within one plan."""
    sizes, cut = [], names.cut

    def measured(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Aggregate [") + plan.count("Join "))
        return cut(df)

    monkeypatch.setattr(names, "cut", measured)
    entities(spark, ["Katherine Meyer; Kathy Meyer; Meyer, K."], ["Annals of Basalt Hydrology", "Ann Basalt Hydr"])
    assert max(sizes) <= 30
