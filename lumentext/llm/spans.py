"""Long exact stretches shared between records: Count-min prefilter, then exact groups of the windows left.

Every window of ``size`` characters is represented by its least hash of ``size // 2`` characters (its anchor), and windows that follow one
another mostly share theirs. Each partition counts the anchors of its records in Count-min sketches, one for each range of anchors, and the merged sketches
never count too low. The second pass groups only windows whose anchor is estimated to occur in two records, so none is lost.
Windows travel by their anchor, a row for each run of them, and are told apart by anchor and hash, 128 bits of their text.

The number of ranges follows from the number of characters, so that the sketches are as full at any size. Where all of them together are small enough to be
held by each task (``held`` bytes), they are broadcast; otherwise the anchors go to the sketch of their range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread, table
from .shingles import merged, mix, sliding_min, starts_inside

#: Hash functions of a sketch, and the binary logarithm of its counters for each.
ROWS, BITS = 3, 18
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x5851F42D4C957F2D


#: Characters that are held as arrays at a time.
HELD = 1 << 20


def _pieces(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, length of each piece, its row, its offset) in turns of about HELD characters.

    Longer texts are cut into pieces that overlap by size - 1 characters, so that each window lies in exactly one.
    """
    held, rows, offs, total = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - size + 1), HELD):
            held.append(t[at : at + HELD + size - 1])
            rows.append(i)
            offs.append(at)
            total += len(held[-1])
            if total >= HELD:
                yield _arrays(held), np.array([len(p) for p in held]), np.array(rows), np.array(offs)
                held, rows, offs, total = [], [], [], 0
    if held:
        yield _arrays(held), np.array([len(p) for p in held]), np.array(rows), np.array(offs)


def _arrays(held: list[str]) -> np.ndarray:
    return np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def window_hashes(chars: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive characters, from sums of a polynomial modulo 2 ** 64."""
    n = len(chars) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.empty(len(chars), np.uint64)
    powers[0], powers[1:] = 1, BASE
    np.multiply.accumulate(powers, out=powers)
    inverse = np.empty(n, np.uint64)
    inverse[0], inverse[1:] = 1, pow(BASE, -1, 1 << 64)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars) * powers, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse)


def anchors(chars: np.ndarray, size: int) -> np.ndarray:
    """The anchor of the window at each position."""
    k = size // 2
    return sliding_min(window_hashes(chars, k), size - k + 1)


def _cells(a: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(a + np.uint64(r * 0x1234567)) >> np.uint64(64 - bits)).astype(np.int64) for r in range(ROWS)]


def _range_of(a: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(a ^ np.uint64(0x7F4A7C15)) % np.uint64(ranges)).astype(np.int64)


def _anchor_runs(b: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, row, first position, number) of the runs of windows with one anchor, with the hashes of all windows in order, of (rep, text)."""
    for chars, n, src, off in _pieces(b.column(1).to_pylist(), size):
        at, owner = starts_inside(n, size)
        if not len(at):
            continue
        a, o = anchors(chars, size)[at], owner[at]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
        first = np.flatnonzero(new)
        pos = at - (np.cumsum(n) - n)[o] + off[o]
        yield a[first], src[o[first]], pos[first], np.diff(np.append(first, len(a))), window_hashes(chars, size)[at]


def capped(c: np.ndarray, length: int) -> np.ndarray:
    """How often each cell is in c, up to two; no byte can overflow."""
    return np.minimum(np.bincount(c, minlength=length), 2).astype(np.uint8)


def add_capped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x + y, 2).astype(np.uint8)


def sketches(reps: DataFrame, size: int, bits: int, ranges: int) -> DataFrame:
    """(block, counts): the merged sketch of each range of anchors, counters up to two of ROWS * 2 ** bits cells. A repeated phrase of one record counts once a run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            r = _range_of(a, ranges)
            order = np.argsort(r, kind="stable")
            a, r = a[order], r[order]
            cuts = np.searchsorted(r, np.unique(r))
            use, packed = [], []
            for s, e in zip(cuts, np.append(cuts[1:], len(a))):
                use.append(int(r[s]))
                packed.append(zlib.compress(np.concatenate([capped(c, 1 << bits) for c in _cells(a[s:e], bits)]).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), pa.array(packed, pa.binary())], names=["block", "counts"])

        for b in batches:
            for a, *_ in _anchor_runs(b, size):
                held.append(a)
                if sum(map(len, held)) > 1 << 22:
                    yield flush()
        yield flush()

    return merged(reps.select("rep", "text").mapInArrow(count, "block long, counts binary"), add_capped, np.uint8)


def _repeated(sketch: bytes) -> np.ndarray:
    """One bit a counter: whether it reached two."""
    return np.packbits(np.frombuffer(zlib.decompress(sketch), np.uint8) >= 2)


def _estimated(a: np.ndarray, row_bits: np.ndarray, bits: int) -> np.ndarray:
    """Whether each anchor is estimated to occur twice by the packed bits of its sketch."""
    ok = np.ones(len(a), bool)
    for r, c in enumerate(_cells(a, bits)):
        c = c + (r << bits)
        ok &= (row_bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _rows(b: pa.RecordBatch, a, src, pos, n, h) -> pa.RecordBatch:
    """A row for each run: anchor, record, first position, and the hashes of its windows as bytes."""
    ends, flat = np.cumsum(n) * 8, h.tobytes()
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), b.column(0).take(pa.array(src)), pa.array(pos.astype(np.int32)), pa.array([flat[e - k * 8 : e] for e, k in zip(ends.tolist(), n.tolist())], pa.binary())], names=["a", "rep", "pos", "hashes"])


def repeated_runs(reps: DataFrame, size: int, bits: int, ranges: int, held: int) -> DataFrame:
    """(a, rep, pos, hashes) of the runs of windows whose anchor is estimated to occur twice."""
    packed, rows = sketches(reps, size, bits, ranges), reps.select("rep", "text")
    if ranges * (ROWS << bits) // 8 <= held:
        kept = reps.sparkSession.sparkContext.broadcast({r.block: _repeated(r.counts).tobytes() for r in packed.toLocalIterator()})

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros((ranges, (ROWS << bits) // 8), np.uint8)
            for r, x in kept.value.items():
                table[r] = np.frombuffer(x, np.uint8)
            for b in batches:
                for a, src, pos, n, h in _anchor_runs(b, size):
                    r, ok = _range_of(a, ranges), np.ones(len(a), bool)
                    for k, c in enumerate(_cells(a, bits)):
                        c = c + (k << bits)
                        ok &= (table[r, c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                    yield _rows(b, a[ok], src[ok], pos[ok], n[ok], h[np.repeat(ok, n)])

        return rows.mapInArrow(go, "a long, rep long, pos int, hashes binary")

    def all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, src, *_ in _anchor_runs(b, size):
                yield pa.RecordBatch.from_arrays([pa.array(_range_of(a, ranges)), pa.array(a.astype(np.int64)), b.column(0).take(pa.array(src))], names=["block", "a", "rep"])

    def choose(found: pa.Table, sketch: pa.Table) -> pa.Table:
        if not found.num_rows or not sketch.num_rows:
            return found.select(["a", "rep"]).slice(0, 0)
        ok = _estimated(found.column("a").to_numpy().astype(np.uint64), _repeated(sketch.column("counts")[0].as_py()), bits)
        return found.select(["a", "rep"]).filter(pa.array(ok))

    # the anchors of a range are dealt to several tasks, by record, each with the sketch of the range
    deals = 4
    found = rows.mapInArrow(all_runs, "block long, a long, rep long").withColumn("deal", F.pmod(F.xxhash64("rep"), F.lit(deals)))
    packed = packed.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)).cast("array<long>")))
    chosen = found.groupBy("block", "deal").cogroup(packed.groupBy("block", "deal")).applyInArrow(choose, "a long, rep long").distinct()
    chosen = chosen.groupBy("rep").agg(F.collect_list("a").alias("anchors"))  # those of one record

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.sort(mix(np.asarray(b.column(2).flatten()).astype(np.uint64)) ^ mix(np.repeat(np.arange(b.num_rows), np.asarray(b.column(2).value_lengths())).astype(np.uint64)))
            for a, src, pos, n, h in _anchor_runs(b, size):
                ok = np.isin(mix(a) ^ mix(src.astype(np.uint64)), own)
                yield _rows(b, a[ok], src[ok], pos[ok], n[ok], h[np.repeat(ok, n)])

    return rows.join(chosen, "rep").select("rep", "text", "anchors").mapInArrow(again, "a long, rep long, pos int, hashes binary")


def shared_windows(runs: DataFrame, size: int, hot: int = 4096, salts: int = 64) -> DataFrame:
    """(rep, lo, hi) of stretches of characters whose windows occur in another record, of (a, rep, pos, hashes).

    Equal windows have equal anchors, so the runs of an anchor are read together. Those of an anchor with more than ``hot`` runs are cut up by the hash of their windows
    and dealt to ``salts`` tasks: equal windows still meet.
    """
    runs = materialize(runs, "runs")
    hot = max(hot, runs.count() // 100_000)
    many = runs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("a", F.lit(True).alias("hot"))
    runs = runs.join(F.broadcast(many), "a", "left")  # at most 100,000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64)
            n = np.array([len(x) // 8 for x in b.column(3).to_pylist()], np.int64)
            own = np.repeat(np.arange(b.num_rows), n)
            pos = np.asarray(b.column(2))[own] + np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            hot = np.array(b.column(4).fill_null(False).to_pylist(), bool)[own]
            part = np.where(hot, (mix(h) % np.uint64(salts)).astype(np.int64), 0)
            yield from _dealt(b, own, part, pos, h)

    def _dealt(b, own, part, pos, h):
        order = np.lexsort((pos, part, own))
        own, part, pos, h = own[order], part[order], pos[order], h[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(own)) * 8
        hs, ps = h.tobytes(), pos.astype(np.int32).tobytes()
        at = pa.array(own[first])
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), pa.array(part[first].astype(np.int32)), b.column(1).take(at), pa.array([ps[s // 2 : e // 2] for s, e in zip((first * 8).tolist(), ends.tolist())], pa.binary()), pa.array([hs[s:e] for s, e in zip((first * 8).tolist(), ends.tolist())], pa.binary())],
            names=["a", "part", "rep", "places", "hashes"],
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            n = np.array([len(x) // 8 for x in t.column("hashes").to_pylist()], np.int64)
            h, pos = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in (("hashes", np.uint64), ("places", np.int32)))
            a, rep = np.repeat(t.column("a").to_numpy(), n), np.repeat(t.column("rep").to_numpy(), n)
            order = np.lexsort((rep, h, a))
            x, y, z = a[order], h[order], rep[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(x)) - 1
            both = np.repeat(z[first] != z[last], last - first + 1)
            keep = order[both]
            rep, pos = rep[keep], pos[keep].astype(np.int64)
            order = np.lexsort((pos, rep))
            rep, pos = rep[order], pos[order]
            new = np.ones(len(rep), bool)
            new[1:] = (rep[1:] != rep[:-1]) | (pos[1:] > pos[:-1] + size)
            first = np.flatnonzero(new)
            ends = pos[np.append(first[1:], len(rep)) - 1] if len(rep) else pos
            return pa.RecordBatch.from_arrays([pa.array(rep[first]), pa.array(pos[first].astype(np.int32)), pa.array((ends + size).astype(np.int32))], names=["rep", "lo", "hi"])

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if not t.num_rows:
                continue
            a, part = t.column("a").to_numpy(), t.column("part").to_numpy()
            cut = int(np.flatnonzero((a != a[-1]) | (part != part[-1]))[-1]) + 1 if (a[0], part[0]) != (a[-1], part[-1]) else 0
            if cut:
                yield shared(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield shared(rest)

    rows = runs.select("a", "rep", "pos", "hashes", "hot").mapInArrow(cut, "a long, part int, rep long, places binary, hashes binary")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(meet, "rep long, lo int, hi int")


def shared_spans(docs: DataFrame, size: int = 120, bits: int = BITS, held: int = 64 << 20) -> DataFrame:
    """(doc_id, start_pos, end_pos): maximal runs of characters that lie in ``size`` characters also found in another record.

    Records with the same text are taken as one and shared whole if they are long enough; so a group of copies of any size
    sends its windows once. NULL and shorter texts have no rows, nor do NULL ids; repeated rows of one doc_id count once; no rows give no rows.
    """
    rows = docs.filter((F.length("text") >= size) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    reps = materialize(keyed.groupBy("sha").agg(F.min(F.struct("doc_id", "text")).alias("m"), F.max("doc_id").alias("last")).select("sha", F.col("m.doc_id").alias("rep"), F.col("m.text").alias("text"), F.expr("m.doc_id < last").alias("copied")), "texts")
    # an anchor holds for half of (size // 2 + 2) windows in the mean; a sketch has two counters for each of a range's
    chars = reps.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, -(-int(chars * 4 / (size // 2 + 2)) // (1 << bits)))
    found = shared_windows(repeated_runs(spread(reps), size, bits, ranges, held), size)
    w = Window.partitionBy("rep").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", (F.col("lo") > F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("rep", "run").agg(F.min("lo").alias("start_pos"), F.max("hi").alias("end_pos"))
    part = reps.filter(~F.col("copied")).select("rep").join(runs, "rep").select(F.col("rep").alias("doc_id"), "start_pos", "end_pos")
    whole = keyed.select("doc_id", "sha", F.length("text").alias("end_pos")).join(reps.filter("copied").select("sha"), "sha").select("doc_id", F.lit(0).alias("start_pos"), "end_pos")
    return part.unionByName(whole).distinct()


def p10_found(spark, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p10_shared(spark, d: str) -> DataFrame:
    """For every document how many of its characters are shared with others, and the share of its text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    n = p10_found(spark, d).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared"))
    share = F.when(F.col("chars") == 0, F.lit(0.0)).otherwise(F.round(F.col("shared") / F.col("chars"), 6))
    return docs.join(n, "doc_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0))).select("doc_id", "chars", "shared", share.alias("share"))
