"""Small helpers shared by the operators: Arrow batches in bounded slices and
word splitting by ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these (space, \t \n \v \f \r).
WHITE = "\\x20\\x09-\\x0D"


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], slice_bytes: int = 1 << 20,
                text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows holding about ``slice_bytes`` of
    text each (a longer text is a slice of its own), so that numpy work arrays
    stay small whatever the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        for i, n in enumerate(byte_lengths(col)):
            if i > start and size + n > slice_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def byte_lengths(col: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_pylist()


def utf8(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null becomes the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]
