"""Two-dimensional float32 matrices in NPY files, as rows."""

from __future__ import annotations

import ast
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x93NUMPY"


def header(data: bytes) -> tuple[tuple[int, int], int]:
    """Shape and offset of the values; refuses all but C-ordered little-endian float32 matrices of format 1 or 2."""
    if data[:6] != MAGIC:
        raise ValueError("not an NPY file")
    version = data[6]
    if version not in (1, 2):
        raise ValueError(f"NPY format {version} isn't supported")
    size, start = (struct.unpack("<H", data[8:10])[0], 10) if version == 1 else (struct.unpack("<I", data[8:12])[0], 12)
    info = ast.literal_eval(data[start : start + size].decode("latin1").strip())
    if info["descr"] != "<f4" or info["fortran_order"] or len(info["shape"]) != 2:
        raise ValueError(f"only C-ordered <f4 matrices can be read, not {info}")
    return tuple(info["shape"]), start + size


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row_no, vec)``; each file is parsed in one task."""

    def parse(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                (rows, cols), at = header(content[:65536])
                m = np.frombuffer(content, dtype="<f4", count=rows * cols, offset=at).reshape(rows, cols)
                for s in range(0, rows, 4096):
                    part = m[s : s + 4096]
                    yield pd.DataFrame({"path": p, "row_no": np.arange(s, s + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, row_no long, vec array<float>")
