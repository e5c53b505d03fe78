"""Languages of pages and of passages within them, by a byte convolutional network over lines.

Training, on the driver, once for each state of the tables (``trained`` keeps the network in the shared folder and loads it from there): lines of clean samples (with misreadings added)
and of at most ``train_docs`` labelled documents, at most ``lines_each`` lines of each, and at most as many samples, the same number of every language; labels in other notations
are read. After some epochs documents and lines that contradict their label are left out, and the network goes on with the rest.

Application: every line of every document is cut into windows of fixed length, whose log probabilities add up. Within a document the languages that are
present are found by expectation maximisation over all lines and by the evidence of the best line or run, whatever the length of the page; then each line weighs its own evidence against its neighbours' languages (lines of
mixed columns alternate, so near lines count, not only adjacent ones). The main language is the one most characters are in.

Defined results: null, empty and blank texts get no language (null, confidence 0); a page without a letter likewise; very long texts are
treated whole, with the memory of their own length; unknown labels count as missing, labels naming another language as wrong.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm.byte_cnn import WINDOW, ByteCnn
from papyrine.session import ensure_checkpoint_dir, exact

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pt"]
#: Codes and English names of the languages.
NOTATIONS = {
    "de": ["de", "deu", "ger", "german"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish"],
    "fr": ["fr", "fra", "fre", "french"],
    "it": ["it", "ita", "italian"],
    "nl": ["nl", "nld", "dut", "dutch"],
    "pt": ["pt", "por", "portuguese"],
}
_MISSING = ["", "und", "unknown", "unk", "n/a", "none", "null", "mis", "mul", "zxx", "xx", "?"]
_VERSION = 2  # of what ``train`` does
_LETTERS = re.compile(r"[^\W\d_]{3}")


def label_language(label: Column) -> Column:
    """The language a label names, in any notation; null if missing, the label itself if it names none of ours."""
    word = F.regexp_replace(F.lower(F.trim(label)), r"[-_].*$", "")
    known = F.create_map(*(F.lit(x) for lang, names in NOTATIONS.items() for n in names for x in (n, lang)))
    return F.when(label.isNull() | word.isin(_MISSING), F.lit(None)).otherwise(F.coalesce(F.element_at(known, word), word))


def misread(text: str, rng: np.random.Generator, rate: float) -> str:
    """A line as a poor scanner might read it."""
    out = []
    for c in text:
        u = rng.random()
        if u < rate:
            k = rng.integers(0, 4)
            if k == 0:
                continue
            out.append(c + "., *'"[rng.integers(0, 5)] if k == 1 else chr(97 + rng.integers(0, 26)) if k == 2 and c.isalpha() else "*")
        else:
            out.append(c)
    return "".join(out)


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    out, at = [], 0
    while at < len(text):
        n = int(rng.integers(18, 60))
        out.append(text[at : at + n])
        at += n
    return out


def train(samples: DataFrame, documents: DataFrame, train_docs: int = 3000, lines_each: int = 25, epochs: int = 6, seed: int = 11) -> ByteCnn:
    """A network from ``samples`` (lang, text) and labelled ``documents`` (doc_id, text, lang)."""
    rng = np.random.default_rng(seed)
    texts, ys, docs = [], [], []
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("sample_no", F.xxhash64("text")))
    clean = samples.filter("text is not null").filter(F.col("lang").isin(LANGUAGES)).withColumn("turn", turn).filter(F.col("turn") <= -(-train_docs // len(LANGUAGES)))
    for r in clean.select("lang", "text", "sample_no").orderBy("lang", "sample_no", F.xxhash64("text")).toLocalIterator():
        if r["text"]:
            for rate in (0.0, 0.03, 0.1):
                for p in _pieces(r["text"], rng):
                    texts.append(misread(p, rng, rate).encode()[:WINDOW])
                    ys.append(LANGUAGES.index(r["lang"]))
                    docs.append(-1)
    labelled = documents.filter("text is not null and doc_id is not null").withColumn("l", label_language(F.col("lang"))).filter(F.col("l").isin(LANGUAGES))
    total = labelled.select("doc_id").count()
    if total > train_docs:  # thinned before the ordering, by far more than the number wanted
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(min(1.0, 1.5 * train_docs / total) * 1_000_000))
    chosen = labelled.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").select("doc_id", "text", "l").limit(train_docs)

    def pick(batches):  # only the picked lines come to the driver, at most WINDOW bytes each
        for pdf in batches:
            rows = []
            for i, text, lang in zip(pdf["doc_id"], pdf["text"], pdf["l"], strict=True):
                lines = [x for x in text.split("\n") if sum(c.isalpha() for c in x) >= 6]
                rows += [(i, lang, lines[k].encode()[:WINDOW]) for k in np.random.default_rng(abs(int(i)) + seed).permutation(len(lines))[:lines_each]]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "line"])

    numbers: dict[int, int] = {}
    for r in chosen.mapInPandas(pick, "doc_id long, lang string, line binary").toLocalIterator():
        texts.append(bytes(r["line"]))
        ys.append(LANGUAGES.index(r["lang"]))
        docs.append(numbers.setdefault(r["doc_id"], len(numbers)))
    y, doc = np.array(ys, dtype=np.int64), np.array(docs)
    net = ByteCnn(LANGUAGES, seed=seed)
    if not len(y):
        return net
    net.train(texts, y, epochs=max(1, epochs // 2), seed=seed)
    lp = np.maximum(net.log_probs(texts), -6)
    sums = np.zeros((doc.max() + 2, len(LANGUAGES)))
    np.add.at(sums, doc + 1, lp)
    agrees = (sums.argmax(1)[doc + 1] == y) & (lp[np.arange(len(y)), y] > -2.5) | (doc < 0)
    net.train([t for t, a in zip(texts, agrees, strict=True) if a], y[agrees], epochs=epochs, seed=seed + 1)
    return net


def state_of(spark: SparkSession, *paths: str) -> str:
    """A name for the present content of some Parquet tables: their files, sizes and times, of which no data are read."""
    rows = sorted(tuple(r) for p in paths for r in spark.read.parquet(p).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect())  # one row a file
    return hashlib.sha256(repr(rows).encode()).hexdigest()[:24]


def trained(samples: DataFrame, documents: DataFrame, state: str, **how) -> ByteCnn:
    """The network for this state of the tables and these parameters: from the shared folder, or trained and kept there."""
    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    name = hashlib.sha256(repr((state, sorted(how.items()), _VERSION)).encode()).hexdigest()[:24]
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/').rsplit('/', 1)[0]}/papyrine-networks/{name}"
    try:
        return ByteCnn.from_bytes(bytes(spark.read.parquet(path).first()["net"]))
    except AnalysisException:  # no such network yet
        net = train(samples, documents, **how)
        spark.createDataFrame([(bytearray(net.to_bytes()),)], "net binary").coalesce(1).write.mode("overwrite").parquet(path)
        return net


_NEAR = {1: 0.7, 2: 1.0, 3: 0.5, 4: 0.5, 5: 0.2, 6: 0.2}


def line_marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the lines of UTF-8 bytes: numbers of letters, whether a line is in capitals (a heading or a name), whether it ends in a broken word."""
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128) | (raw >= 0xC3) & (raw < 0xE0)  # without continuation bytes
    ends = np.append(np.flatnonzero(raw == 10), len(raw))

    def per_line(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(flags)])[ends]])).astype(float)

    upper, lower = per_line((raw >= 65) & (raw <= 90)), per_line((raw >= 97) & (raw <= 122))
    padded = np.concatenate([np.zeros(3, dtype=np.uint8), raw])
    a, b, c = padded[ends], padded[ends + 1], padded[ends + 2]
    broken = np.isin(c, np.frombuffer(b"-=~*_", dtype=np.uint8)) | (b == 0xC2) & ((c == 0xAC) | (c == 0xAD)) | (a == 0xE2) & (b == 0x80) & ((c >= 0x90) & (c <= 0x92))
    return per_line(letter), (upper >= 3) & (lower <= 0.15 * upper), broken


#: Natural logarithm of how much more likely a line or run must be in another language than in the main one for that language to be on the page.
_EVIDENCE = 4.0


def evidence(lp: np.ndarray, letters: np.ndarray, doc: np.ndarray, main: np.ndarray, capitals: np.ndarray) -> np.ndarray:
    """For documents and languages: the log-likelihood gain over the main language of the best run of up to four lines, side by side or every other one.

    It doesn't depend on the length of the page; a line of few letters, often a name, counts less.
    """
    rows = np.arange(len(doc))
    gain = (lp - lp[rows, main[doc]][:, None]) * (np.minimum(1.0, letters / 20.0) * np.where(capitals, 0.6, 1.0))[:, None]
    best = gain.copy()
    for step in (1, 2):
        run = gain
        for k in range(step, 4 * step, step):
            if k >= len(doc):
                break
            run = run[:-step] + gain[k:]
            np.maximum(best[:-k], np.where((doc[k:] == doc[:-k])[:, None], run, -np.inf), out=best[:-k])
    return np.maximum.reduceat(best, np.searchsorted(doc, np.arange(len(main))), axis=0)


def smooth(lp: np.ndarray, letters: np.ndarray, doc: np.ndarray, capitals: np.ndarray | None = None, broken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For lines of documents (``doc`` ascending from 0, without gaps): the lines' languages as probabilities, and each document's main language.

    A line in capitals goes with the lines that follow it, a line of a few letters with the line whose broken word it may end.
    """
    none = np.zeros(len(doc), dtype=bool)
    capitals, broken = none if capitals is None else capitals, none if broken is None else broken
    n_docs = int(doc[-1]) + 1
    first = np.searchsorted(doc, np.arange(n_docs))
    trust = (np.minimum(1.0, letters / 14.0) * np.where(capitals, 0.6, 1.0))[:, None]
    short = (letters <= 8) & ~capitals
    p = np.exp(lp * trust)
    p = p / p.sum(1, keepdims=True) * 0.99 + 0.01 / lp.shape[1]
    weight = np.minimum(letters, 60)[:, None] + 0.01
    r, share = p, np.zeros((n_docs, lp.shape[1]))
    for _ in range(6):
        share = np.add.reduceat(r * weight, first, axis=0)
        share = share / share.sum(1, keepdims=True)
        r = p * (share[doc] + 1e-4)
        r /= r.sum(1, keepdims=True)
    lines = np.add.reduceat(r * np.minimum(1.0, letters / 15.0)[:, None], first, axis=0)
    main = share.argmax(1)
    present = (lines >= 0.9) | (evidence(lp, letters, doc, main, capitals) >= _EVIDENCE)  # many weak lines, or a sure one however long the page
    present[np.arange(n_docs), main] = True
    q = p * np.where(present[doc], 1.0, 1e-4)
    r = q * (share[doc] + 0.02)
    r /= r.sum(1, keepdims=True)
    for _ in range(4):
        near = 0.15 * share[doc]
        heavy = r * np.minimum(1.0, letters / 8.0)[:, None]
        for d, k in _NEAR.items():
            if d < len(doc):
                same = (doc[d:] == doc[:-d])[:, None] * k
                near[d:] += same * heavy[:-d]
                near[:-d] += same * heavy[d:]
        ahead, one, two = np.zeros_like(near), np.zeros_like(near), np.zeros_like(near)
        ahead[:-1] = (doc[1:] == doc[:-1])[:, None] * heavy[1:]
        one[1:] = (doc[1:] == doc[:-1])[:, None] * heavy[:-1] * (1 + 3 * broken[:-1, None])
        if len(doc) > 2:
            ahead[:-2] += (doc[2:] == doc[:-2])[:, None] * heavy[2:] * 0.3
            two[2:] = (doc[2:] == doc[:-2])[:, None] * heavy[:-2] * (0.3 + 3 * broken[:-2, None])
        near = np.where(capitals[:, None], 0.05 * near + ahead, np.where(short[:, None], 0.1 * near + one + two, near))
        near /= near.sum(1, keepdims=True)
        r = q * (near + 0.01)
        r /= r.sum(1, keepdims=True)
    hard = np.zeros_like(r)
    hard[np.arange(len(r)), r.argmax(1)] = letters + 1e-6
    return r, np.add.reduceat(hard, first, axis=0).argmax(1)


_OUT = "doc_id long, label string, main string, confidence float, line_no array<int>, lang array<string>, sure array<float>"


def detect(documents: DataFrame, net: ByteCnn, most_bytes: int = 4_000_000) -> DataFrame:
    """``(doc_id, label, main, confidence, line_no[], lang[], sure[])``: the main language and the lines in other languages."""
    src = exact(documents, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), "text", label_language(F.col("lang")).alias("label"))

    def some(texts: list[str], tables: list):
        data = [t.encode() for t in texts]
        lp, _ = net.line_log_probs(b"\n".join(data), tables)
        counts = np.array([d.count(b"\n") + 1 for d in data])
        doc = np.repeat(np.arange(len(data)), counts)
        letters, capitals, broken = line_marks(np.frombuffer(b"\n".join(data), dtype=np.uint8))
        r, main = smooth(lp, letters, doc, capitals, broken)
        best = r.argmax(1)
        own = best == main[doc]
        first = np.searchsorted(doc, np.arange(len(data)))
        total = np.add.reduceat(letters, first)
        good = np.add.reduceat(r[np.arange(len(r)), main[doc]] * own * (letters + 1e-9), first)
        sure = good / np.maximum(np.add.reduceat(own * (letters + 1e-9), first), 1e-9)
        foreign = np.flatnonzero(~own & (letters >= 3))
        at: list[list] = [[] for _ in data]
        split: dict[int, list[str]] = {}
        for i in foreign.tolist():
            d = int(doc[i])
            if d not in split:
                split[d] = texts[d].split("\n")
            k = i - int(first[d])
            if _LETTERS.search(split[d][k]):
                at[d].append((k + 1, LANGUAGES[best[i]], float(r[i, best[i]])))
        return [LANGUAGES[m] if t > 0 else None for m, t in zip(main, total, strict=True)], np.where(total > 0, sure, 0.0), at

    def run(batches):
        tables = net.tables()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs, sures, ats = [], [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= most_bytes):
                    size += len(texts[j])
                    j += 1
                m, s, a = some(texts[i:j], tables)
                langs += m
                sures += list(s)
                ats += a
                i = j
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(langs, pa.string()), pa.array(sures, pa.float32()), pa.array([[x[0] for x in a] for a in ats], pa.list_(pa.int32())), pa.array([[x[1] for x in a] for a in ats], pa.list_(pa.string())), pa.array([[x[2] for x in a] for a in ats], pa.list_(pa.float32()))],
                names=["doc_id", "label", "main", "confidence", "line_no", "lang", "sure"],
            )

    return src.mapInArrow(run, _OUT)


def cases(found: DataFrame) -> DataFrame:
    """``(doc_id, line_no, lang)``: pages with a missing or wrong label (line 0), and lines in another language."""
    page = F.when(F.col("main").isNotNull() & (F.col("label").isNull() | (F.col("label") != F.col("main"))), F.array(F.struct(F.lit(0).alias("line_no"), F.col("main").alias("lang")))).otherwise(F.array().cast("array<struct<line_no:int,lang:string>>"))
    return found.select("doc_id", F.explode(F.concat(page, F.arrays_zip("line_no", "lang"))).alias("c")).select("doc_id", "c.line_no", "c.lang")


def segments(found: DataFrame, gap: int = 3) -> DataFrame:
    """``(doc_id, first_line, last_line, lang, confidence, lines)``: the page (lines null) and its passages; the lines of a passage lie at most ``gap`` apart."""
    line = F.explode(F.arrays_zip("line_no", "lang", "sure")).alias("l")
    w = Window.partitionBy("doc_id", "lang").orderBy("line_no")
    rows = found.select("doc_id", line).select("doc_id", "l.line_no", "l.lang", "l.sure")
    rows = rows.withColumn("new", F.when(F.col("line_no") - F.lag("line_no").over(w) <= gap, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    parts = rows.groupBy("doc_id", "lang", "part").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.round(F.avg("sure"), 4).alias("confidence"), F.count("*").cast("int").alias("lines"))
    none = F.lit(None).cast("int")
    pages = found.select("doc_id", none.alias("first_line"), none.alias("last_line"), F.col("main").alias("lang"), F.round(F.col("confidence").cast("double"), 4).alias("confidence"), none.alias("lines"))
    return pages.unionByName(parts.select("doc_id", "first_line", "last_line", "lang", "confidence", "lines"))
