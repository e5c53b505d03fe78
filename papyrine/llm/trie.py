"""Pairs of distinct words within a bounded edit distance, and words that shorten others, by trie joins.

Words are sharded by letters that the edits leave as they are. One edit (insertion, deletion, substitution, exchange of neighbours) leaves the first or the
last k = (n - 1) // 2 letters of the shorter word (n letters). Two edits, allowed where the shorter word has ``long`` letters or more, leave its first or its last k = n // 4 letters, or, with one edit at
either end, what lies between, one letter off at most. So two words within the distance meet in a shard. Each shard builds a trie of its words and
traverses it with the Levenshtein automaton of every word, leaving a branch as soon as no state is left.

Shortened words: the words that begin with a letter are one trie, whose nodes know the letters below them; a short word goes down it letter by letter, skipping letters of the
longer word, and leaves a branch that lacks a letter still wanted. Many short words of a letter are dealt to several tasks.

Defined results: null and empty words take no part; words shorter than ``least`` letters are not joined; a pair comes once, smaller word first.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Automaton:
    """Nondeterministic automaton of the words within ``edits`` edits of ``word``; its deterministic steps are kept."""

    def __init__(self, word: str, edits: int = 1):
        self.word, self.edits, self.known = word, edits, {}
        self.start = frozenset({(0, 0, False)})

    def step(self, state: frozenset, c: str) -> frozenset:
        key = (state, c)
        if key not in self.known:
            w, n, out = self.word, len(self.word), set()
            for i, e, swapped in state:
                if swapped:
                    if w[i] == c:
                        out.add((i + 2, e, False))
                    continue
                if i < n and w[i] == c:
                    out.add((i + 1, e, False))
                if e < self.edits:
                    out.add((i, e + 1, False))
                    if i < n:
                        out.add((i + 1, e + 1, False))
                    for skip in range(1, self.edits - e + 1):
                        if i + skip < n and w[i + skip] == c:
                            out.add((i + skip + 1, e + skip, False))
                    if i + 1 < n and w[i + 1] == c:
                        out.add((i, e + 1, True))
            self.known[key] = frozenset(out)
        return self.known[key]

    def accepts(self, state: frozenset) -> bool:
        return any(not swapped and e + len(self.word) - i <= self.edits for i, e, swapped in state)


def shard_pairs(words: list[str], edits: int = 1) -> list[tuple[str, str]]:
    """Pairs of the shard's words at most ``edits`` apart."""
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    out = []
    for w in words:
        auto = Automaton(w, edits)
        stack = [(trie, auto.start)]
        while stack:
            node, state = stack.pop()
            for c, below in node.items():
                if c == "":
                    if w < below and auto.accepts(state):
                        out.append((w, below))
                else:
                    after = auto.step(state, c)
                    if after:
                        stack.append((below, after))
    return out


def near_pairs(words: DataFrame, column: str, least: int = 3, edits: int = 1, long: int = 10) -> DataFrame:
    """``(a, b)``: pairs of distinct words one edit apart; with ``edits=2`` also two edits where the shorter word has ``long`` letters (nine at least) or more."""
    w = words.select(F.col(f"`{column}`").alias("w")).filter(F.length("w") >= max(least, 3)).distinct()
    n = F.length("w")
    k1, k2 = F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")
    one = w.withColumn("k", F.explode(F.array_distinct(F.array(k1, k2)))).filter("k > 0")
    ends = F.array(F.struct(F.lit("first").alias("side"), F.expr("substring(w, 1, k)").alias("part")), F.struct(F.lit("last").alias("side"), F.expr("right(w, k)").alias("part")))
    shards = one.select("w", "k", F.explode(ends).alias("e")).select("w", F.lit(1).alias("edits"), "k", "e.side", "e.part")
    if edits >= 2:
        # k: letters of the shorter word, this one or up to two letters shorter.
        two = w.withColumn("k", F.explode(F.expr("transform(sequence(0, 2), d -> cast(length(w) - d as int))"))).filter(F.col("k") >= max(long, 9))
        parts = "array(named_struct('side', 'first', 'part', substring(w, 1, k div 4)), named_struct('side', 'last', 'part', right(w, cast(k div 4 as int))))"
        middle = "transform(sequence(-1, 1), s -> named_struct('side', 'middle', 'part', substring(w, cast(k div 4 + 2 + s as int), cast(k - 2 * (k div 4) - 2 as int))))"
        two = two.select("w", "k", F.explode(F.expr(f"array_distinct(concat({parts}, {middle}))")).alias("e")).select("w", F.lit(2).alias("edits"), "k", "e.side", "e.part")
        shards = shards.unionByName(two)
    keys = ["edits", "k", "side", "part"]
    # A word alone in its shard has no pair there.
    several = shards.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(shard_pairs(sorted(set(pdf["w"])), int(key[0])), columns=["a", "b"])

    # The shards' bytes are few for the work they make: spread by number, not by size.
    spread = shards.join(several, keys).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return spread.groupBy(*keys).applyInPandas(run, "a string, b string").distinct()


def shortened(short: list[str], words: list[str], skips: int = 5) -> list[tuple[str, str]]:
    """``(short, word)``: longer words of the trie that a short word begins or, having at most ``skips`` letters, whose letters it has in order, the first one first."""
    trie: dict = {}
    below: dict[int, frozenset] = {}  # letters below each node
    for w in words:
        rest = [frozenset()]
        for c in reversed(w):
            rest.append(rest[-1] if c in rest[-1] else rest[-1] | {c})
        node = trie
        for c in w:
            node = node.setdefault(c, {})
            rest.pop()
            below[id(node)] = below.get(id(node), frozenset()) | rest[-1]
        node[""] = w
    out = []
    for s in short:
        node = trie.get(s[0])
        stack = [(node, 1, 1)] if node is not None else []  # node, letters of s found, letters gone down
        while stack:
            node, i, depth = stack.pop()
            if i == len(s) and "" in node and depth > i:
                out.append((s, node[""]))
            if i < len(s) and not set(s[i:]) <= below[id(node)]:
                continue
            for c, n in node.items():
                if not c:
                    continue
                if i < len(s) and c == s[i]:
                    stack.append((n, i + 1, depth + 1))
                elif i == len(s) or len(s) <= skips:
                    stack.append((n, i, depth + 1))
    return out


def abbreviations(short: DataFrame, words: DataFrame, fits: Callable[[str, str], bool], slice_words: int = 2000) -> DataFrame:
    """``(a, b)``: words ``b`` that are longer than ``a`` and that ``a`` shortens, as ``fits`` says."""
    a = short.select(F.col(short.columns[0]).alias("w")).filter("w <> ''").distinct()
    b = words.select(F.col(words.columns[0]).alias("w")).filter("w <> ''").distinct()
    first = F.substring("w", 1, 1).alias("c")
    slices = a.groupBy(first).agg(F.ceil(F.count("*") / slice_words).cast("int").alias("slices"))
    asked = a.select("w", first).join(slices, "c").select("w", "c", F.pmod(F.xxhash64("w"), F.col("slices")).cast("int").alias("slice"))
    held = b.select("w", first).join(slices, "c").select("w", "c", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = [p for p in shortened(sorted(left["w"]), sorted(right["w"])) if fits(*p)]
        return pd.DataFrame(got, columns=["a", "b"])

    return asked.groupBy("c", "slice").cogroup(held.groupBy("c", "slice")).applyInPandas(run, "a string, b string")
