"""Spellings that mean the same person or the same venue.

Every distinct spelling is parsed once; words within the bounded edit distance come from a trie join (``trie.near_pairs``) over the distinct words; whether
two spellings agree in any order of their words is decided on keys that have no order.

Persons: a spelling gives a family name (all its parts, particles left out), a first given name, full or shortened, and the initial of a further one. The order of two plain words
is the one in which the corpus mostly has them. They are joined in steps, each over connected groups of the one before, so that no step chains what it finds unclear:

1. Typing errors: family and given names equal or near, further initials equal. Near means ``edits`` edits (one, exchanges included; two from ``long`` letters on if asked for);
   of family names of three or four letters an exchange of neighbours, or an edit if the other is ten times as frequent. Given names that are near or short forms but both common in the corpus (with ``common`` family names or more) must mostly
   occur with the same families, as spellings of one name do: Mario and Maria don't, Sören and Soeren do. So must common family names with given names.
2. A group without further initial joins the one group with such an initial that agrees otherwise; if there are several, none. Conflicting initials never meet.
3. Short given names: those of the list ``short_forms``, beginnings of three letters or more, and endings if the corpus supports them (three families have both, at least half of those that have
   the ending). They join the one group of that family they can mean (its most frequent given name counts for a group); if several, none: Chris is neither Christian nor Christopher where both exist.
4. Spellings with an initial or an abbreviation join the one group of that family whose given name begins so and whose further initial doesn't conflict; if several could be meant, they stay with their like.

Venues: words are put right against near words that are at least four times as frequent; order, case, remarks in brackets and linking words
don't count. Shortened words (beginnings, or up to five letters in order) are found by a trie join over the distinct words: the longest word of each key goes down the trie of all words, keys
with equal initials that have such a word are candidates, and a matching of the words in any order decides. A key joins the one full key it abbreviates, beginnings going before other letters in order. Initials alone match the one venue with these initials.

Defined results: null and blank spellings, "et al." and spellings without a letter take no part. Repeated spellings count once. Ties go to the
smaller string. Very long spellings are treated whole. Given names of one or two letters have no near ones: an edit leaves too little of them; those of more than 64 have no short form. Empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm.trie import abbreviations, near_pairs
from papyrine.operators.graph import connected_components
from papyrine.session import cut, exact


def read_forms(path: str | Path) -> list[tuple[str, str]]:
    """``(short, full)`` of a file with a full name and its short forms a line."""
    lines = Path(path).read_text(encoding="utf-8").splitlines()
    return [(w, line.split()[0]) for line in lines if line.strip() and not line.startswith("#") for w in line.split()[1:]]


#: Usual short forms of given names (a general list, see the file); a parameter of ``persons``.
SHORT_FORMS = read_forms(Path(__file__).with_name("short_forms.txt"))
_TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "jr", "sr", "mag", "ing", "dipl"}
_PARTICLES = {"von", "van", "der", "den", "de", "di", "da", "del", "della", "la", "le", "al", "el", "du", "dos", "ten", "ter", "zu", "zum", "af"}
_LINKING = {"of", "in", "on", "the", "and", "for"}
_GENERAL = {"proceedings", "proc", "international", "int", "intl"}


def fold(s: str) -> str:
    s = s.casefold().replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("đ", "d").replace("ł", "l").replace("ð", "d").replace("þ", "th").replace("ı", "i")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def parse_person(spelling: str) -> tuple[str, str, str, bool, bool] | None:
    """Family name, first given name, initial of a further one, whether the given name is shortened, whether the order is a guess."""
    comma = spelling.find(",")
    words = []  # (folded letters, shortened, before the comma, second letter of several initials)
    for m in re.finditer(r"[^\s,.]+\.?", spelling):
        raw = m.group()
        dot = raw.endswith(".")
        word = fold(raw).replace("-", "").replace("‐", "")
        word = "".join(c for c in word if c.isalpha())
        if not word or word in _TITLES or (len(word) > 1 and word in _PARTICLES):
            continue
        plain = raw.rstrip(".")
        initials = len(word) <= 3 and plain.isupper() and (len(word) == 1 or not spelling.isupper() and not any(c in "aeiouy" for c in word) or (len(word) == 2 and not spelling.isupper()))
        words.append((word[0] if initials else word, initials or dot and len(word) <= 4, 0 <= m.start() < comma, word[1:2] if initials else ""))
    if not words:
        return None

    def further(given: list[tuple]) -> str:
        return given[0][3] or (given[1][0][0] if len(given) > 1 else "") if given else ""

    if any(w[2] for w in words):
        family = [w[0] for w in words if w[2]]
        given = [w for w in words if not w[2]]
        return "".join(family), given[0][0] if given else "", further(given), bool(given and given[0][1]), False
    long = [w for w in words if not w[1]]
    if not long:
        return "".join(w[0] for w in words), "", "", False, False
    if len(words) == 1:
        return words[0][0], "", "", False, False
    if words[-1][1] and not words[0][1]:  # family name first, then initials
        given = [words[-1]] if len(words) == 2 else [w for w in words if w[1]]
        return "".join(w[0] for w in long), given[0][0], further(given), True, False
    first = words[0]
    rest = [w[0] for w in words[1:] if not w[1]]
    return "".join(rest) or first[0], first[0], further([first, *(w for w in words[1:] if w[1])]) if rest else "", first[1], len(words) == 2 and not first[1]


def _persons(spellings: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for s, n in zip(pdf["spelling"], pdf["n"], strict=True):
                if fold(s).replace(".", "").strip() in {"et al", "et alii", "others"}:
                    continue
                if p := parse_person(s):
                    rows.append((s, n, *p))
            yield pd.DataFrame(rows, columns=["spelling", "n", "family", "given", "mid", "short", "guess"])

    parsed = cut(spellings.mapInPandas(run, "spelling string, n long, family string, given string, mid string, short boolean, guess boolean"))
    # Which of two plain words is the given name: the one the corpus has more often in that place.
    roles = parsed.filter("not short and given <> ''").select(F.explode(F.array(F.struct(F.col("given").alias("word"), F.lit(1).alias("g")), F.struct(F.col("family").alias("word"), F.lit(0).alias("g")))).alias("r"))
    roles = roles.groupBy("r.word").agg(F.avg("r.g").alias("share"))
    a, b = roles.select(F.col("word").alias("given"), F.col("share").alias("share_g")), roles.select(F.col("word").alias("family"), F.col("share").alias("share_f"))
    guess = parsed.filter("guess").join(a, "given").join(b, "family")
    turn = F.col("share_f") > F.col("share_g")
    guess = guess.select("spelling", "n", F.when(turn, F.col("given")).otherwise(F.col("family")).alias("family"), F.when(turn, F.col("family")).otherwise(F.col("given")).alias("given"), "mid", "short")
    return cut(parsed.filter("not guess").select("spelling", "n", "family", "given", "mid", "short").unionByName(guess))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _exchanged(a: str, b: str) -> Column:
    """Whether two words one edit apart have the same letters, so that the edit is an exchange."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    return letters(a) == letters(b)


def _together(pairs: DataFrame, names: DataFrame, word: str, beside: str) -> DataFrame:
    """``pairs`` of ``word`` with the numbers of ``beside`` each occurs with (ka, kb) and both occur with."""
    k = names.groupBy(word).agg(F.count("*").alias("k"))
    x, y = names.select(F.col(word).alias("a"), beside), names.select(F.col(word).alias("b"), beside)
    both = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", beside]).groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(k.select(F.col(word).alias("a"), F.col("k").alias("ka")), "a").join(k.select(F.col(word).alias("b"), F.col("k").alias("kb")), "b")
    return out.join(both, ["a", "b"], "left").fillna(0, ["both"])


def persons(spellings: DataFrame, short_forms: list[tuple[str, str]] = SHORT_FORMS, edits: int = 1, long: int = 10, common: int = 5) -> DataFrame:
    """``(spelling, entity)`` for ``(spelling, n)``; ``short_forms``: (short, full) of given names; ``edits``: at most so many in words of ``long`` letters or more."""
    spark = spellings.sparkSession
    parsed = _persons(spellings)
    full = cut(parsed.filter("not short and given <> ''").groupBy("family", "given", "mid").agg(F.count("*").alias("n")).withColumn("node", F.concat_ws("|", "family", "given", "mid")))
    names = cut(full.select("family", "given").distinct())
    givens, families = cut(names.select("given").distinct()), cut(parsed.groupBy("family").agg(F.sum("n").alias("n")))

    # Given names: near ones, and (a, b) with a short for b.
    near = _together(cut(near_pairs(givens, "given", 3, edits, long)), names, "given", "family")
    near = _both_ways(near.filter((F.least("ka", "kb") < common) | (F.col("both") >= 0.3 * F.least("ka", "kb")))).withColumn("kind", F.lit("near"))
    known = spark.createDataFrame(short_forms, "a string, b string").distinct().withColumn("how", F.lit("known"))
    ends = givens.filter(F.length("given") <= 64).select("given", F.explode(F.expr("filter(transform(sequence(3, greatest(3, length(given) - 1)), i -> struct(substring(given, 1, i) as begin, right(given, i) as end)), p -> length(given) > 3)")).alias("p"))
    ends = ends.select(F.col("given").alias("b"), F.explode(F.array(F.struct(F.col("p.begin").alias("a"), F.lit("begin").alias("how")), F.struct(F.col("p.end").alias("a"), F.lit("end").alias("how")))).alias("e")).select("e.a", "b", "e.how")
    less = known.unionByName(ends.join(givens.withColumnRenamed("given", "a"), "a", "left_semi")).filter("a <> b").distinct()
    less = _together(cut(less), names, "given", "family").withColumn("all", F.sum("both").over(Window.partitionBy("a", "how")))
    common_enough = (F.col("ka") < common) | (F.col("all") >= 0.3 * F.col("ka"))
    supported = (F.col("both") >= 3) & (F.col("both") >= 0.5 * F.col("ka"))
    less = less.filter(F.when(F.col("how") == "end", supported).otherwise(common_enough)).select("a", "b").distinct().withColumn("kind", F.lit("short"))
    given_pairs = cut(near.unionByName(less))

    # Family names.
    na, nb = families.select(F.col("family").alias("a"), F.col("n").alias("na")), families.select(F.col("family").alias("b"), F.col("n").alias("nb"))
    close = cut(near_pairs(families, "family", 3, edits, long)).join(na, "a").join(nb, "b")
    close = cut(close.filter((F.least(F.length("a"), F.length("b")) >= 5) | _exchanged("a", "b") | (F.greatest("na", "nb") >= 10 * F.least("na", "nb"))))
    counted = _together(close.select("a", "b"), names, "family", "given")
    # Families of which no given name is known in full stay: whom they are is decided by the initials.
    close = close.join(counted, ["a", "b"], "left").filter("ka is null or kb is null or least(ka, kb) < {0} or both >= 0.8 * least(ka, kb)".format(common))
    close = cut(close.select("a", "b", "na", "nb"))
    around = cut(_both_ways(close))

    # Pairs of nodes whose names agree: (node, node2, mid, mid2, kind).
    n2 = full.select(F.col("family").alias("family2"), F.col("given").alias("given2"), F.col("mid").alias("mid2"), F.col("node").alias("node2"))
    same = full.select("node", "mid", F.col("family").alias("family2"), "given")
    near_family = full.join(around, full["family"] == around["a"]).select("node", "mid", F.col("b").alias("family2"), "given")
    other_given = same.unionByName(near_family).join(given_pairs, F.col("given") == F.col("a")).select("node", "mid", "family2", F.col("b").alias("given2"), "kind")
    equal_given = same.unionByName(near_family).select("node", "mid", "family2", F.col("given").alias("given2"), F.lit("near").alias("kind"))
    links = cut(other_given.unionByName(equal_given).join(n2, ["family2", "given2"]).filter("node <> node2 and (mid = mid2 or mid = '' or mid2 = '')").select("node", "node2", "mid", "mid2", "kind").distinct())

    alone = full.select("node", F.col("node").alias("node2"))
    groups = cut(connected_components(links.filter("kind = 'near' and mid = mid2").select("node", "node2").unionByName(alone), "node", "node2").select(F.col("id").alias("node"), F.col("component").alias("g")))
    other = groups.select(F.col("node").alias("node2"), F.col("g").alias("g2"))
    one = lambda d: d.groupBy("g").agg(F.min("g2").alias("lo"), F.max("g2").alias("hi")).filter("lo = hi").select("g", F.col("lo").alias("to"))
    bare = one(links.filter("kind = 'near' and mid = '' and mid2 <> ''").join(groups, "node").join(other, "node2"))
    groups = cut(groups.join(bare, "g", "left").select("node", F.coalesce("to", "g").alias("g")))

    # Short given names: the groups a group may belong to that don't belong to another one themselves.
    at = cut(full.join(groups, "node"))
    main = cut(at.groupBy("g").agg(F.max(F.struct("n", F.col("given").alias("main")))["main"].alias("main"), F.max("mid").alias("mid")))
    spoken = at.join(main.select("g", "main"), "g").filter("given = main").select("node", "g")
    other = groups.select(F.col("node").alias("node2"), F.col("g").alias("g2"))
    may = cut(links.filter("kind = 'short'").join(spoken, "node").join(other, "node2").filter("g <> g2").select("g", "g2").distinct())
    last = may.join(may.select(F.col("g").alias("g2")).distinct(), "g2", "left_anti")
    to = cut(one(last).join(main.select("g", "mid"), "g"))
    mids = to.join(main.select(F.col("g").alias("to"), F.col("mid").alias("mid2")), "to")
    clash = mids.groupBy("to").agg(F.size(F.array_distinct(F.filter(F.concat(F.collect_set("mid"), F.collect_set("mid2")), lambda m: m != ""))).alias("k")).filter("k > 1").select("to")
    unclear = mids.join(clash, "to").filter("mid <> '' and mid <> mid2").select("g")
    to = to.join(unclear, "g", "left_anti").select("g", "to")
    named = cut(at.join(to, "g", "left").select("family", "given", "mid", F.coalesce("to", "g").alias("component")))

    # Shortened given names join the one person they can mean.
    short = cut(parsed.filter("short or given = ''").select("family", "given", "mid").distinct())
    of = named.groupBy("component").agg(F.max("mid").alias("mid2"))
    begins = cut(named.select("family", "component", F.explode(F.expr("transform(sequence(1, least(4, length(given))), i -> substring(given, 1, i))")).alias("given")).distinct().join(of, "component"))
    fits = F.expr("mid = '' or mid2 = '' or mid = mid2")
    key = ["family", "given", "mid"]
    own = cut(short.join(begins, ["family", "given"]).filter(fits).groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    beside = short.join(own, key, "left_anti").join(around.select(F.col("a").alias("family"), F.col("b").alias("family2")), "family").join(begins.withColumnRenamed("family", "family2"), ["family2", "given"]).filter(fits)
    beside = beside.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    sure = cut(own.unionByName(beside).filter("lo = hi").select(*key, F.col("lo").alias("component")))
    up = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") > F.col("b")))
    better = close.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("rare"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("frequent")).groupBy("rare").agg(F.min("frequent").alias("better"))
    left = short.join(sure, key, "left_anti").join(better, F.col("family") == F.col("rare"), "left")
    left = cut(left.select(*key, F.concat(F.coalesce("better", "family"), F.lit("|"), F.substring("given", 1, 1), F.lit(".")).alias("like")))
    mids = left.filter("mid <> ''").groupBy("like").agg(F.min("mid").alias("lo"), F.max("mid").alias("hi"))
    left = left.join(mids, "like", "left").select(*key, F.concat("like", F.when((F.col("mid") == "") & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("mid"))).alias("component"))
    a = parsed.filter("not short and given <> ''").join(named, key)
    b = parsed.filter("short or given = ''").join(sure.unionByName(left), key)
    return a.select("spelling", F.col("component").alias("entity")).unionByName(b.select("spelling", F.col("component").alias("entity")))


def parse_venue(spelling: str) -> tuple[list[str], str, bool]:
    """Its words in order without linking words, its initials, whether it consists of initials only."""
    text = fold(spelling)
    brackets = re.findall(r"\(([^)]*)\)", text)
    text = re.sub(r"\([^)]*\)", " ", text)
    moved = [b for b in brackets if re.search(r"\b(of|on|in|for)\s*$", b)]
    letters = re.fullmatch(r"\W*((?:[a-z]\.){2,}[a-z]?\.?|[a-z]{3,6})\W*", text)
    if letters and (spelling.strip(" .()").replace(".", "").isupper()):
        return [], "".join(c for c in letters.group(1) if c.isalpha()), True
    if "," in text:
        head, _, tail = text.partition(",")
        text = f"{tail} {head}"
    text = " ".join(moved) + " " + text
    words = [w for w in re.findall(r"[^\W\d_]+", text) if w not in _LINKING]
    return words, "".join(w[0] for w in words), False


def abbreviates(short: str, full: str) -> bool:
    """Same first letter and a beginning, or up to five letters in order."""
    if short == full or full.startswith(short):
        return True
    if not short or short[0] != full[0] or len(short) > 5 or len(short) >= len(full):
        return False
    it = iter(full)
    return all(c in it for c in short)


def agree(short: list[str], full: list[str], fit=abbreviates) -> bool:
    """Whether the words of ``short`` abbreviate those of ``full`` in some order: a matching of all of them, by augmenting paths."""
    if len(short) != len(full):
        return False
    fits = [[j for j, f in enumerate(full) if fit(w, f)] for w in short]
    taken: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        for j in fits[i]:
            if j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(short)))


def whole_keys(keyed: DataFrame) -> DataFrame:
    """``(key, entity)`` for distinct ``(key, block)``: the one full key of its block that a key abbreviates, else itself."""
    words = cut(keyed.select("key", "block", F.explode(F.array_distinct("key")).alias("word")))
    longest = F.array_sort("key", lambda x, y: F.when(F.length(x) > F.length(y), -1).when(F.length(x) < F.length(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0))[0]
    asked = cut(keyed.select("key", "block", longest.alias("a")))
    pairs = abbreviations(asked.select("a"), words.select("word"), abbreviates)
    equal = asked.select("a", F.col("a").alias("b")).distinct()
    other = words.select("block", F.col("word").alias("b"), F.col("key").alias("full"))
    candidates = asked.join(pairs.unionByName(equal), "a").join(other, ["block", "b"]).filter(F.col("key") != F.col("full")).select("key", "full").distinct()

    def decide(batches):
        for pdf in batches:
            keep = [agree(list(k), list(f)) and not agree(list(f), list(k)) for k, f in zip(pdf["key"], pdf["full"], strict=True)]
            begins = [agree(list(k), list(f), lambda a, b: b.startswith(a)) for k, f in zip(pdf["key"], pdf["full"], strict=True)]
            yield pdf.assign(begins=begins)[keep]

    over = cut(candidates.mapInPandas(decide, "key array<string>, full array<string>, begins boolean"))
    top = over.join(over.select(F.col("key").alias("full")).distinct(), "full", "left_anti")
    # Beginnings of all words go before letters in order: Ling is Linguistics rather than Limnology.
    best = top.groupBy("key").agg(F.min(F.struct(~F.col("begins"), "full"))["full"].alias("lo"), F.bool_or("begins").alias("any"), F.count_if("begins").alias("k"), F.count("*").alias("n"))
    top = best.filter("if(any, k, n) = 1").select("key", "lo")
    return keyed.select("key").join(top, "key", "left").select("key", F.array_join(F.coalesce("lo", "key"), " ").alias("entity"))


def venues(spellings: DataFrame, edits: int = 1, long: int = 10) -> DataFrame:
    """``(spelling, entity)`` for ``(spelling, n)``."""

    def run(batches):
        for pdf in batches:
            rows = [(s, n, *parse_venue(s)) for s, n in zip(pdf["spelling"], pdf["n"], strict=True)]
            yield pd.DataFrame(rows, columns=["spelling", "n", "words", "initials", "bare"])

    parsed = cut(spellings.mapInPandas(run, "spelling string, n long, words array<string>, initials string, bare boolean").filter("bare or size(words) > 0"))
    words = parsed.filter("not bare").select("spelling", "n", F.posexplode("words").alias("at", "word"))
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("n")))
    sided = _both_ways(cut(near_pairs(counts, "word", 3, edits, long))).filter((F.least(F.length("a"), F.length("b")) >= 5) | _exchanged("a", "b"))
    ca, cb = counts.select(F.col("word").alias("a"), F.col("n").alias("na")), counts.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    better = sided.join(ca, "a").join(cb, "b").filter("nb >= 4 * na and not startswith(b, a)").groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("right"))
    fixed = words.join(better, words["word"] == better["a"], "left").select("spelling", "at", F.coalesce("right", "word").alias("word"))
    keyed = fixed.groupBy("spelling").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda e: e["word"]).alias("words"))
    general = F.array(*(F.lit(w) for w in sorted(_GENERAL)))
    keyed = keyed.select("spelling", F.array_join(F.transform("words", lambda w: F.substring(w, 1, 1)), "").alias("initials"), F.array_sort(F.filter("words", lambda w: ~F.array_contains(general, w))).alias("key"))
    keyed = cut(keyed.filter(F.size("key") > 0))
    block = F.array_join(F.array_sort(F.transform("key", lambda w: F.substring(w, 1, 1))), "").alias("block")
    groups = cut(whole_keys(cut(keyed.select("key", block).distinct())))
    named = cut(keyed.join(groups, "key").select("spelling", "initials", "entity"))
    # Initials belong to the one venue whose words begin so; the order is that of the spellings of the full key.
    whole = named.groupBy("initials", "entity").agg(F.count("*").alias("n"))
    one = whole.groupBy("initials").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi")).filter("lo = hi").select("initials", F.col("lo").alias("entity"))
    bare = parsed.filter("bare").select("spelling", "initials").join(one, "initials", "left")
    return named.select("spelling", "entity").unionByName(bare.select("spelling", F.coalesce("entity", F.concat(F.lit("="), "initials")).alias("entity")))


def spellings_of(cart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(spelling, n)`` of the persons in ``authors`` and of the venues."""
    cart = exact(cart, "authors", "venue")
    person = cart.select(F.explode(F.split("authors", ";")).alias("s")).select(F.regexp_replace("s", r"^\s+|\s+$", "").alias("spelling"))
    venue = cart.select(F.col("venue").alias("spelling"))
    return tuple(x.filter(F.col("spelling").rlike(r"\p{L}")).groupBy("spelling").agg(F.count("*").alias("n")) for x in (person, venue))


def variants(cart: DataFrame) -> DataFrame:
    """``(kind, spelling, entity)``: every distinct spelling once."""
    p, v = spellings_of(cart)
    return cut(persons(p).select(F.lit("author").alias("kind"), "spelling", "entity").unionByName(venues(v).select(F.lit("venue").alias("kind"), "spelling", "entity")))


def pairs(found: DataFrame) -> DataFrame:
    """``(kind, name_a, name_b)``: pairs of different spellings of one entity."""
    a = found.withColumnRenamed("spelling", "name_a")
    b = found.withColumnRenamed("spelling", "name_b")
    return a.join(b, ["kind", "entity"]).filter("name_a < name_b").select("kind", "name_a", "name_b")
