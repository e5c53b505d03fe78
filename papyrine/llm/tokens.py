"""Lengths of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import exact

#: Default of the parameter ``vocabulary``, a file the driver reads.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(vocabulary: str | bytes = VOCABULARY):
    """The encoding of a vocabulary file, or of its content."""
    import tiktoken

    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, ident: str, text: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``(id, tokens, kept columns)``; a null text has 0 tokens. Whole texts are encoded, one Arrow batch at a time.

    The vocabulary (fixed, about a megabyte) is read by the driver and broadcast, so executors need no file of that path.
    """
    src = exact(df, ident, text, *keep).select(F.col(f"`{ident}`").cast("long").alias("id"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("text"))
    names = ["id", *(f"k{i}" for i in range(len(keep)))]
    schema = ", ".join(["id long", *(f"k{i} {src.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "tokens long"])

    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoding(content.value)
        for b in batches:
            counts = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(counts, pa.int64())], names=[*names, "tokens"])

    return src.mapInArrow(run, schema).select("id", "tokens", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))
