"""Top N rows of every group by a streamed secondary sort.

Rows are sorted by group, score and identifier inside the partitions they already lie in, and Arrow batches are
streamed past a counter that lets N rows of each run through. Only those few rows are hash-partitioned by group,
sorted and streamed once more. No group is buffered, and a group that holds a third of all rows is cut down to N
rows per input partition before anything of it moves.

Defined results: null scores rank after all others, null identifiers after all others of their score, NaN before all
numbers (Spark's order). Rows equal in score and identifier are ordered by their remaining orderable columns, so
the result is the same whatever the partitioning. Exact repeats count as rows. A null group key is a group of its own.
An empty table gives an empty result. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _differs(col: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before it (nulls equal each other, NaN equals NaN)."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    ne = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
    both_null = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    out = ne & ~both_null
    if pa.types.is_floating(col.type):
        out &= ~(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False))
    return out


def _first_rows(indices: Sequence[int], n: int):
    """A mapInArrow function that passes the first ``n`` rows of each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row seen
        seen = 0  # rows of its run so far
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, dtype=bool)
            new[0] = last is None
            for i in indices:
                col = batch.column(i)
                new[1:] |= _differs(col)
                if last is not None:
                    new[0] |= bool(_differs(pa.concat_arrays([last.column(i), col.slice(0, 1)]))[0])
            at = np.arange(rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            rank = np.where(start >= 0, at - start, at + seen)
            keep = np.flatnonzero(rank < n)
            seen = int(rank[-1]) + 1
            last = batch.slice(rows - 1, 1)
            if len(keep):
                yield batch.take(pa.array(keep))

    return run


def top_n(df: DataFrame, groups: Sequence[str], score: str, ident: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``, ties by the smaller ``ident``; columns as in ``df``."""
    if n < 1:
        return df.limit(0)
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))  # names that clash don't matter from here on
    keys, by, tie = [names.index(g) for g in groups], names.index(score), names.index(ident)
    c = lambda i: F.col(f"c{i}")
    no_order = (T.MapType, T.VariantType, T.ArrayType, T.StructType)
    rest = [i for i, f in enumerate(plain.schema.fields) if i not in {*keys, by, tie} and not isinstance(f.dataType, no_order)]
    order = [*(c(i).asc_nulls_first() for i in keys), c(by).desc_nulls_last(), c(tie).asc_nulls_last(), *(c(i).asc_nulls_last() for i in rest)]
    step = _first_rows(keys, n)
    local = plain.sortWithinPartitions(*order).mapInArrow(step, plain.schema)
    return local.repartition(*(c(i) for i in keys)).sortWithinPartitions(*order).mapInArrow(step, plain.schema).toDF(*names)
