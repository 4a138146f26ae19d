"""Running a kernel over whole texts in bounded pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# The characters between words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

# A piece holds at most so many rows, and so many bytes of text unless one text is larger.
PIECE_ROWS = 1024
PIECE_BYTES = 2 << 20

ROW_KEY = ["__row_a", "__row_b"]

Kernel = Callable[[list], list]


def pieces(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold a bounded number of rows and bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        fit = int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))
        stop = max(start + 1, min(fit, start + PIECE_ROWS))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame, keep: list[Column], text: Column, start: Callable[[], Kernel], fields: str
) -> DataFrame:
    """The columns ``keep`` and those of ``fields``, which a kernel makes from each text.

    ``start`` runs once in each task and returns the kernel: from a list of texts (strings
    or bytes as ``text`` is, None for null) to one list for each of ``fields``. It
    sees whole texts, a bounded number of rows at a time; rows are neither moved nor lost.
    """
    rows = df.select(*keep, text.alias("__text"))
    made = T.StructType.fromDDL(fields)
    schema = T.StructType(rows.schema.fields[:-1] + made.fields)
    place = len(keep)
    kinds = [to_arrow_type(f.dataType) for f in made.fields]

    def run(batches):
        kernel = start()
        for batch in batches:
            for piece in pieces(batch, place):
                texts = piece.column(place).to_pylist()
                columns = [pa.array(x, kind) for x, kind in zip(kernel(texts), kinds)]
                kept = [piece.column(i) for i in range(place)]
                yield pa.RecordBatch.from_arrays(kept + columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` and the columns ROW_KEY: 128 bits that stand for all values of a row, nulls and
    their places among them, so that only full repeats share them. Unlike a row number they
    need no second copy of the rows."""
    values = [F.col(f"`{c}`") for c in df.columns]
    marks = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    first, second = F.xxhash64(F.lit(7), marks, *values), F.xxhash64(F.lit(11), *values, marks)
    return df.withColumns(dict(zip(ROW_KEY, (first, second))))
