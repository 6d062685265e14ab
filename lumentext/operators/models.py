"""Seams for models: encoders, taggers, readers and generators are given by the caller.

A model is given as a function that makes it, called once for each task on the worker that uses it, and returns a function from a list of inputs
to a list of outputs. Rows travel in Arrow batches; no model is shipped from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

Maker = Callable[[], Callable[[list], list]]


def apply_model(df: DataFrame, inputs: str | list[str], make: Maker, out: str, kind: str, batch: int = 64) -> DataFrame:
    """``df`` with a column ``out`` of type ``kind``: the model's output for ``inputs``, a text or several as tuples.

    The model sees ``batch`` rows at a time, NULL inputs among them. A column of the name ``out`` is replaced; no rows give no rows.
    """
    cols = [inputs] if isinstance(inputs, str) else list(inputs)
    df = df.drop(out) if out in df.columns and out not in cols else df
    schema = StructType([*df.schema.fields, StructField(out, _parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                model = model or make()
                b = whole.slice(at, batch)
                given = [b.column(b.schema.get_field_index(c)).to_pylist() for c in cols]
                made = list(model(given[0] if isinstance(inputs, str) else list(zip(*given))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, arrow.field(out).type)], names=[*b.schema.names, out])

    return df.mapInArrow(go, schema)


def encoded(df: DataFrame, key: str, text: str, make: Maker) -> DataFrame:
    """(key, vec): vectors of unit length from a model that encodes texts; NULL texts as empty ones, a zero vector stays."""
    from ..functions import text as T

    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return apply_model(rows, "_text", make, "vec", "array<double>").select(key, T.unit(F.col("vec")).alias("vec"))


def tagged(df: DataFrame, key: str, tokens: str, make: Maker) -> DataFrame:
    """(key, pos, token, tag) from a model that gives a tag for each token of a list; lists of another length are an error of the model."""
    rows = apply_model(df.select(key, F.col(tokens).alias("_tokens")), "_tokens", make, "_tags", "array<string>")
    rows = rows.select(key, F.posexplode(F.arrays_zip("_tokens", "_tags")).alias("pos", "t"))
    return rows.select(key, "pos", F.col("t._tokens").alias("token"), F.coalesce("t._tags", F.lit("O")).alias("tag"))


def first_present(*paths: str) -> str | None:
    """The first of the paths that exists on the driver: a model of one's own before a default."""
    import os

    return next((p for p in paths if p and os.path.exists(p)), None)
