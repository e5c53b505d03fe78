"""Words and phrases of texts, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of labels.
STOP_WORDS = (
    "the a an and or of to in for on with by from as at is are be this that "
    "we our using use based via into over under between within across new "
    "approach method methods model models results result study analysis "
    "paper which can may not but its their these those also more most such "
    "than then they them was were has have had been being it he she his her"
).split()
#: Function words of other languages, left out of the rarest labels.
FOREIGN_WORDS = (
    "para com que uma foram dos das por foi mas como este esta sao ser son del "
    "las los una con fue por sus est une des pour avec sur dans nel della delle"
).split()


def tokens(text: Column) -> Column:
    """Lower-case words of three or more letters or digits, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    stop = F.array(*(F.lit(w) for w in sorted(set(STOP_WORDS))))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def phrases(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` neighbouring words; longer runs are zipped from shorter ones, so the words are evaluated once for each length."""
    runs = [words]
    for n in range(2, longest + 1):
        pairs = F.zip_with(runs[-1], F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.filter(pairs, lambda r: r.isNotNull()))
    return F.concat(*runs)


def is_junk(term: Column) -> Column:
    """Whether one of its words is a number or a function word of another language."""
    foreign = F.array(*(F.lit(w) for w in sorted(set(FOREIGN_WORDS))))
    return F.exists(F.split(term, " "), lambda w: w.rlike(r"^\d+$") | F.array_contains(foreign, w))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two phrases."""
    x, y = F.split(a, " "), F.split(b, " ")
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def share_list(counts: Column) -> Column:
    """``id:percent%`` for an array of structs (id, fraction), separated by blanks."""
    return F.array_join(F.transform(counts, lambda e: F.concat(e["id"].cast("string"), F.lit(":"), F.round(e["fraction"] * 100).cast("int").cast("string"), F.lit("%"))), " ")


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
