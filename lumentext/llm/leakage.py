"""Evaluation texts inside training text: MinHash search of equal windows with an exact check.

This stands in place of a size-partitioned MinHash containment search, which is not built: there are no size classes.

Both sides are cut into domains of one size, windows of ``run`` words, so that containment of an item's window in a
document means equality of two domains, whatever the sizes of item and document. The MinHash of a domain is the least hash of
its ``k``-word shingles. Equal domains have equal MinHashes, so the search loses nothing. The MinHashes of all items' windows are kept as a
bitmap of fixed size, which every task holds; a document sends only the windows whose MinHash is in it, as words, and these are joined with the
items' windows: exact containment, without sending any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, skew_join, spread, table
from .shingles import WORD, WordHashes, runs_hash, sliding_min, starts_inside

#: Bits of a MinHash that the bitmap is addressed by: 2 MB, whatever the number of items.
BITS = 24


def domains(df: DataFrame, key: str, run: int, k: int, bitmap=None) -> DataFrame:
    """(key, cell, run): the distinct windows of ``run`` words of each text, joined by blanks, with the cell of their MinHash; of the bitmap's cells only, if given."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        known = WordHashes()
        for b in batches:
            words = [WORD.findall(t.lower()) if t else [] for t in b.column(1).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            toks = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(n.sum()))
            at, owner = starts_inside(n, run)
            least = sliding_min(runs_hash(toks, k), run - k + 1)
            at = at[at < len(least)]
            cell = (least[at] >> np.uint64(64 - BITS)).astype(np.int64)
            if bits is not None:
                ok = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                at, cell = at[ok], cell[ok]
            first = np.cumsum(n) - n
            rows = {(o, " ".join(words[o][p : p + run])): c for o, p, c in zip(owner[at].tolist(), (at - first[owner[at]]).tolist(), cell.tolist())}
            own = pa.array([o for o, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(own), pa.array(rows.values(), pa.int64()), pa.array([r for _, r in rows], pa.string())], names=[key, "cell", "run"])

    rows = df.select(key, "text").filter(F.col(key).isNotNull())
    return rows.mapInArrow(go, f"{key} {rows.schema[0].dataType.simpleString()}, cell long, run string")


def leaks(docs: DataFrame, items: DataFrame, run: int = 13, k: int = 9) -> DataFrame:
    """(doc_id, item_id, shared, of): documents that hold ``run`` consecutive words of an item.

    shared / of: how many of the item's distinct runs the document holds. NULL ids, NULL, empty and shorter texts match nothing;
    repeated rows count once; no rows give no rows. Items may be many: a fuller bitmap lets more windows through and changes no result. A run that
    stands in very many documents is dealt to several tasks.
    """
    held = materialize(domains(items, "item_id", run, k).distinct(), "items")
    bits = np.zeros(1 << BITS, np.uint8)
    for r in held.select("cell").distinct().toLocalIterator():  # at most 2 ** BITS
        bits[r.cell] = 1
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    found = materialize(domains(docs, "doc_id", run, k, bitmap).select("doc_id", "run").distinct(), "runs")
    both = skew_join(found, held.select("item_id", "run"), "run", found.groupBy("run").agg(F.count(F.lit(1)).alias("n")))
    of = held.groupBy("item_id").agg(F.count(F.lit(1)).alias("of"))
    return both.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")).join(of, "item_id").select("doc_id", "item_id", "shared", "of")


def p9_leaks(spark, d: str) -> DataFrame:
    """Each leak with the share of the item found."""
    return leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items")).select("doc_id", "item_id", "shared", "of")


def p9_found(spark, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")
