"""Planted cases in made-up data: what share of them is found, and what share of what is found is planted."""

import random

import numpy as np

from papyrine.llm import density, language, names, neighbours

ALPHABET = ["ba", "ke", "lo", "mi", "ru", "sta", "tre", "vo", "zi", "gal", "dun", "fer", "hov", "pim", "quo", "wes"]


def both(found: set, planted: set) -> tuple[float, float]:
    return len(found & planted) / len(planted), len(found & planted) / max(1, len(found))


def test_groups(spark):
    """Groups of ten to four hundred members, of very different density, amid as many scattered nodes."""
    rng = np.random.default_rng(11)
    parts, truth = [], []
    for g, (size, spread) in enumerate([(10, 0.05), (15, 1.0), (25, 0.3), (60, 2.0), (120, 0.2), (400, 3.0), (200, 1.0), (12, 0.02)]):
        centre = np.array([60 * (g % 3), 60 * (g // 3 % 3), 60 * (g // 9)])
        shape = np.diag([1.0, rng.uniform(0.3, 1), rng.uniform(0.1, 1)])
        x = rng.uniform(-1, 1, (size * 3, 3))
        x = x[(x**2).sum(1) <= 1][:size]  # a ball, later an ellipsoid
        parts.append(centre + x @ shape * spread * 2)
        truth += [g] * len(parts[-1])
    parts.append(rng.uniform(-40, 160, (800, 3)))
    truth += [-1] * 800
    x, truth = np.concatenate(parts), np.array(truth)
    near = np.zeros(len(x), dtype=bool)
    for g in range(8):  # scattered nodes inside or beside a group are no case
        m = x[truth == g]
        near |= (truth < 0) & (np.linalg.norm(x - m.mean(0), axis=1) < 4 * np.linalg.norm(m - m.mean(0), axis=1).max())
    x, truth = x[~near], truth[~near]
    order = rng.permutation(len(x))
    x, truth = x[order], truth[order]
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    p = neighbours.usable(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 3)
    for block in (16384, 200):
        found = {tuple(r) for r in density.chain(density.cluster(p, 3, block_rows=block)).collect()}
        planted = {(int(a), int(b)) for g in range(8) for m in [np.flatnonzero(truth == g)] for a, b in zip(m, m[1:], strict=False)}
        recall, precision = both(found, planted)
        assert recall > 0.95 and precision > 0.95


def typed(word: str, rng: random.Random) -> str:
    i = rng.randrange(1, len(word) - 1)
    return [word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + "x" + word[i + 1 :]][rng.randrange(4)]


def test_spellings_of_persons(spark):
    """Persons with typing errors, initials, further initials, short forms, exchanged parts and capitals; several persons share a family name."""
    rng = random.Random(4)
    given = [("William", "Bill"), ("Katherine", "Kathy"), ("Robert", "Bob"), ("Margaret", "Peggy"), ("Friedrich", "Fritz"), ("Giuseppe", "Beppe"), ("Theodore", "Ted"), ("Victoria", "Vicky"), ("Quentin", "Quen"), ("Yolanda", "Yol")]
    spellings: dict[str, int] = {}
    person = 0
    for k in range(120):
        family = "".join(rng.choice(ALPHABET) for _ in range(4)).capitalize()
        for full, short in rng.sample(given, 2 if k % 4 == 0 else 1):
            mid = rng.choice("ABCD")
            forms = [f"{full} {family}", f"{family}, {full}", f"{full} {mid}. {family}", f"{short} {family}", f"{full.upper()} {family.upper()}", f"{full} {typed(family, rng)}", f"{typed(full, rng)} {family}", f"Dr. {full} {family}", f"{full[0]}. {family}", f"{family} {full[0]}."]
            for f in [forms[0], *rng.sample(forms[1:], 6)]:
                spellings[f] = person if f not in spellings or spellings[f] == person else -1
            person += 1
    df = spark.createDataFrame([(f"{s}; et al.", None) for s in spellings], "authors string, venue string")
    found = {(r["name_a"], r["name_b"]) for r in names.pairs(names.variants(df)).collect()}
    own = {s: p for s, p in spellings.items() if p >= 0}
    planted = {(a, b) for a in own for b in own if a < b and own[a] == own[b]}
    recall, precision = both({(a, b) for a, b in found if a in own and b in own}, planted)
    assert recall > 0.95 and precision > 0.98


def test_languages_of_pages_and_lines(spark):
    """Pages made of the clean samples' second halves, with passages and single lines in another language; the network has seen the first halves and labelled pages."""
    samples = spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet").toPandas().sort_values(["lang", "sample_no"])
    half = {lang: d.text.tolist() for lang, d in samples.groupby("lang")}
    first = spark.createDataFrame([(lang, i, t) for lang, ts in half.items() for i, t in enumerate(ts[: len(ts) // 2])], "lang string, sample_no int, text string")
    words = {lang: " ".join(ts[len(ts) // 2 :]).split() for lang, ts in half.items()}
    rng = np.random.default_rng(3)

    def lines(lang, n):
        out = []
        for _ in range(n):
            i = int(rng.integers(0, len(words[lang]) - 8))
            out.append(" ".join(words[lang][i : i + 7]))
        return out

    pages, planted = [], set()
    for i in range(140):
        main, other = (language.LANGUAGES[k] for k in rng.permutation(7)[:2])
        text = lines(main, int(rng.integers(12, 60)))
        if i % 2:
            n = [1, 4, 6][i % 3]
            at = int(rng.integers(0, len(text)))
            text[at:at] = lines(other, n)
            planted |= {(i, at + k + 1, other) for k in range(n)}
        label = main
        if i % 5 == 0:
            label, planted = (None, other)[i % 2], planted | {(i, 0, main)}
        pages.append((i, "\n".join(text), label))
    docs = spark.createDataFrame(pages, "doc_id long, text string, lang string")
    net = language.train(first, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = {tuple(r) for r in language.cases(language.detect(docs, net)).collect()}
    recall, precision = both(found, planted)
    assert recall > 0.9 and precision > 0.9
