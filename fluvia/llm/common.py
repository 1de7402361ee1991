"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fluvia.session import ship

#: Rows of a batch that are held as Python objects at a time.
SLICE_ROWS = 512
#: ... and bytes of Arrow data, whichever is reached first.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data directory."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the documents table."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds few rows and bytes (one long row may exceed them)."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, int(SLICE_ROWS * SLICE_BYTES / max(1, batch.nbytes / max(1, batch.num_rows) * SLICE_ROWS))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], list[list]]],
    added: str,
    text: str = "text",
    extra: tuple[str, ...] = (),
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add columns computed from each row's text, in Arrow batches and without a shuffle.

    make() is called once per task and returns a function from (texts, *extra columns) as Python
    lists to one list per added column. Columns of docs stay, except those in `drop`; an added
    column replaces one of docs with the same name.
    """
    fields = T._parse_datatype_string(added).fields
    names = {f.name for f in fields}
    kept = [f for f in docs.schema.fields if f.name not in names and f.name not in drop]
    keep = [f.name for f in kept]
    types = [_arrow_type(f.dataType) for f in fields]
    out = T.StructType([*kept, *fields])
    order = [f.name for f in out.fields]

    def run(batches):
        work = make()
        for part in slices(batches):
            columns = work(part.column(part.schema.get_field_index(text)).to_pylist(), *(part.column(part.schema.get_field_index(c)).to_pylist() for c in extra))
            arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v, t) for v, t in zip(columns, types, strict=True))], order)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, out)

