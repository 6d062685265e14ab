"""Frequency of every distinct value: range-partitioned sort and run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_blank, table


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (field, val, scope, w) to one row for each run of equal (field, val) in a batch."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for name in ("field", "val"):
            col = b.column(name)
            if n > 1:
                new[1:] |= ~np.asarray(pa.compute.equal(col.slice(1), col.slice(0, n - 1)))
        at = np.flatnonzero(new)
        has = np.asarray(b.column("scope").is_valid()).astype(np.int64)
        total = np.add.reduceat(b.column("w").to_numpy(zero_copy_only=False), at)
        scopes = np.add.reduceat(has, at)
        idx = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [b.column("field").take(idx), b.column("val").take(idx), pa.array(total), pa.array(scopes)],
            names=["field", "val", "total", "scopes"],
        )


def value_frequencies(rows: DataFrame) -> DataFrame:
    """(field, val, scope, w) to (field, val, total, scopes), one row for each distinct value.

    The rows are first summed to one for each (field, val, scope), on the map side too, so that no hot value
    or scope reaches one task whole. These are sorted by ranges of (field, val, scope); a value with many
    scopes may span several ranges, and its partial runs are added at the end. NULL and blank values have
    no row, a NULL weight counts 0, a NULL scope adds to the total only. No rows give no rows.
    """
    pairs = (
        rows.filter(~is_blank(F.col("val")))
        .groupBy("field", "val", "scope")
        .agg(F.sum(F.coalesce(F.col("w"), F.lit(0)).cast("long")).alias("w"))
    )
    runs = (
        pairs.repartitionByRange("field", "val", "scope")
        .sortWithinPartitions("field", "val", "scope")
        .mapInArrow(_scan_runs, "field string, val string, total long, scopes long")
    )
    return runs.groupBy("field", "val").agg(F.sum("total").alias("total"), F.sum("scopes").alias("scopes"))


def mark_frequencies(freq: DataFrame, n_scopes: DataFrame, rules: dict[str, tuple[float, int]], min_common: int = 3) -> DataFrame:
    """(field, val, mark) of the values marked ``rare`` or ``common``.

    n_scopes: (field, n), a row for each field. rules: field -> (share of all scopes above which a value in at
    least ``min_common`` scopes is common, highest total at which a value of one scope is rare).
    """
    share, most = F.lit(None).cast("double"), F.lit(None).cast("long")
    for f, (s, m) in rules.items():
        share = F.when(F.col("field") == f, F.lit(s)).otherwise(share)
        most = F.when(F.col("field") == f, F.lit(m)).otherwise(most)
    mark = F.when((F.col("scopes") >= min_common) & (F.col("scopes") > share * F.col("n")), F.lit("common")).when(
        (F.col("scopes") == 1) & (F.col("total") <= most), F.lit("rare")
    )
    # n_scopes has one row a field, a fixed number
    return freq.join(F.broadcast(n_scopes), "field").select("field", "val", mark.alias("mark")).filter("mark is not null")


#: field -> table, value, scope, weight, rule
FIELDS = {
    "personagens_final.personagem": ("personagens_final", "personagem", "livro_id", "frequencia", (0.10, 2)),
    "wiki_human_spaceflight_entities.text": ("wiki_human_spaceflight_entities", "text", "source_id", "count", (0.25, 1)),
}


def _rows(spark, d: str) -> tuple[DataFrame, DataFrame]:
    rows, n = [], []
    for field, (t, val, scope, w, _) in FIELDS.items():
        df = table(spark, d, t)
        rows.append(df.distinct().select(F.lit(field).alias("field"), F.col(val).alias("val"), F.col(scope).alias("scope"), F.col(w).alias("w")))
        n.append(df.agg(F.count_distinct(scope).alias("n")).select(F.lit(field).alias("field"), "n"))
    return rows[0].unionByName(rows[1]), n[0].unionByName(n[1])


def p3_frequencies(spark, d: str) -> DataFrame:
    """Every distinct value with its total and its number of scopes."""
    return value_frequencies(_rows(spark, d)[0])


def p3_found(spark, d: str) -> DataFrame:
    rows, n = _rows(spark, d)
    return mark_frequencies(value_frequencies(rows), n, {f: x[4] for f, x in FIELDS.items()})
