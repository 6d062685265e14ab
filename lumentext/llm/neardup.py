"""Near-duplicate records: ProbMinHash signatures of weighted shingles, banding, exact verification.

Each shingle of a record is a Poisson process whose rate is its weight; its arrivals fall on random registers, and each register
keeps the element of the earliest. Two records agree in a register with their probability Jaccard similarity, which for
equal weights is the Jaccard similarity of the sets. A record's processes end once no later arrival can win a register.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, small, spread, table
from .shingles import WordHashes, merged, mix, runs_hash, starts_inside


def word_units(t: str) -> list[str]:
    """Lower-cased words, split at white space of any kind."""
    return t.lower().split()


def char_units(t: str) -> str:
    """Lower-cased characters, white space runs made one blank, trimmed."""
    return " ".join(t.lower().split())


def shingles(texts: list[str | None], units: Callable, k: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles of the texts in order, how many of each text)."""
    parts = [units(t) if t else () for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    if units is char_units:
        toks = np.frombuffer("".join(p for p in parts if p).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    else:
        toks = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.uint64, int(n.sum()))
    return runs_hash(toks, k)[starts_inside(n, k)[0]], np.maximum(n - k + 1, 0)


def shingle_sets(texts: list[str | None], units: Callable, k: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, times): the distinct shingles of each of up to 65,536 texts, by owner, as hashes of 48 bits, and how often each occurs."""
    h, n = shingles(texts, units, k, known)
    x = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(48), n) | (h >> np.uint64(16)))
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return (x[first] >> np.uint64(48)).astype(np.int64), x[first] & np.uint64((1 << 48) - 1), np.diff(np.append(first, len(x)))


def probminhash(owner: np.ndarray, elems: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m signatures: for each owner and register the element that arrives first."""
    best, sig = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    o, e, w = owner, elems, weights.astype(float)
    time, state = np.zeros(len(e)), mix(elems)
    while len(e):
        state = mix(state)
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / w
        cell = o * m + (mix(state ^ np.uint64(0x5DEECE66D)) % np.uint64(m)).astype(np.int64)
        better = time < best[cell]
        c, t = cell[better], time[better]
        np.minimum.at(best, c, t)
        won = best[c] == t
        sig[c[won]] = e[better][won]
        latest = best.reshape(n, m).max(axis=1)
        on = time < latest[o]
        o, e, w, time, state = o[on], e[on], w[on], time[on], state[on]
    return sig.reshape(n, m)


#: Counters of the Count-min sketch of shingles, for each of its rows; cells of a block of it as they are merged.
CELLS, ROWS, BLOCK = 1 << 20, 1, 1 << 16
#: Weight of a shingle that many records have, such as those of the template of their site.
COMMON_WEIGHT = 0.25
#: Shingles that occur less often are not common in tables of any size.
LEAST_COMMON = 50


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (mix(h + np.uint64(row * 0x2545F5)) & np.uint64(CELLS - 1)).astype(np.int64)


def levelled(df: DataFrame, units: Callable, k: int, count: bool) -> DataFrame:
    """(id, sha, level) of (id, text): the text after case and white space are levelled, and its digest. Texts of fewer than k units are left out.

    count: also rows (block, counts), each partition's Count-min sketch of how often each shingle occurs.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sketch = WordHashes(), np.zeros((ROWS, CELLS if count else 0), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                at, level = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    words = word_units(t) if t else []
                    flat = " ".join(words)
                    if (len(words) if units is word_units else len(flat)) >= k:
                        at.append(i), level.append(flat)
                if count:
                    h, _ = shingles(level, units, k, known)
                    for r in range(ROWS):
                        sketch[r] += np.bincount(_cells(h >> np.uint64(16), r), minlength=CELLS)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in level]
                n = len(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(sha, pa.binary()), pa.array(level, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["id", "sha", "level", "block", "counts"])
        flat = sketch.reshape(-1, BLOCK)
        use = np.flatnonzero(flat.any(axis=1))
        n = len(use)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.string()), pa.array(use.astype(np.int64)), pa.array([zlib.compress(flat[i].tobytes(), 1) for i in use], pa.binary())], names=["id", "sha", "level", "block", "counts"])

    return df.select("id", "text").filter("id is not null and text is not null").mapInArrow(go, "id long, sha binary, level string, block long, counts binary")


def common_cells(level: DataFrame, share: float) -> np.ndarray:
    """For each row of the merged sketch, packed bits: which cells count more than ``share`` of the records, and more than LEAST_COMMON. ROWS * CELLS / 8 bytes, whatever the data."""
    most = max(LEAST_COMMON, share * level.filter("id is not null").count())
    out = np.zeros((ROWS * CELLS // BLOCK, BLOCK // 8), np.uint8)
    for r in merged(level.filter("block is not null").select("block", "counts"), np.add, np.int64).toLocalIterator():
        out[r.block] = np.packbits(np.frombuffer(zlib.decompress(r.counts), np.int64) > most)
    return out.reshape(ROWS, -1)


def bands(df: DataFrame, units: Callable, k: int, n_bands: int, n_rows: int, common: np.ndarray | None = None) -> DataFrame:
    """(id, h): a hash for each band of each record's signature. Records without a shingle have none.

    A shingle's weight is how often it occurs, less if it is common.
    """
    kept = df.sparkSession.sparkContext.broadcast(common)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = WordHashes(), kept.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                owner, h, times = shingle_sets(b.column(1).to_pylist(), units, k, known)
                weight = times.astype(float)
                if often is not None:
                    many = np.ones(len(h), bool)
                    for r in range(ROWS):
                        c = _cells(h, r)
                        many &= (often[r][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                    weight[many] *= COMMON_WEIGHT
                use, o = np.unique(owner, return_inverse=True)
                sig = probminhash(o, h, weight, len(use), n_bands * n_rows).reshape(len(use), n_bands, n_rows)
                x = np.arange(n_bands, dtype=np.uint64)[None, :] + np.zeros((len(use), 1), np.uint64)
                for r in range(n_rows):
                    x = mix(x) + sig[:, :, r]
                ids = b.column(0).take(pa.array(np.repeat(use, n_bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(mix(x).reshape(-1).astype(np.int64))], names=["id", "h"])

    return df.select("id", "text").mapInArrow(go, "id long, h long")


def run_pairs(h: np.ndarray, ids: np.ndarray, hot: int, large: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, h) of whole runs of h: a pair of ids, or a = b for each id of a run of more than ``hot``, or of the run that is known to be ``large``."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(h)))
    two = first[n == 2]
    members = np.repeat((n > hot) | (h[first] == large if large is not None else False), n)
    a, b, k = [ids[members], ids[two]], [ids[members], ids[two + 1]], [h[members], h[two]]
    for at, size in zip(first[(n > 2) & (n <= hot)], n[(n > 2) & (n <= hot)]):
        if large is None or h[at] != large:
            u, v = np.triu_indices(size, 1)
            a.append(ids[at + u]), b.append(ids[at + v]), k.append(np.full(len(u), h[at]))
    a, b, k = (np.concatenate(x) for x in (a, b, k))
    return np.minimum(a, b), np.maximum(a, b), k


def bucket_pairs(rows: DataFrame, hot: int = 2048, salts: int = 64) -> DataFrame:
    """Distinct (a, b), a < b, of ids with a common bucket h; rows: (id, h), distinct.

    The rows are sorted by bucket once, and each bucket is read as a run. One of up to ``hot`` ids gives its pairs at once; the ids of a
    larger one are passed on as they come, to a join of one side dealt to ``salts`` tasks, so that no task holds the bucket or its pairs.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, ids, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        out = lambda a, b, k: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k)], names=["a", "b", "h"])
        for batch in batches:
            h, ids = np.concatenate([h, batch.column(1).to_numpy()]), np.concatenate([ids, batch.column(0).to_numpy()])
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0
            yield out(*run_pairs(h[:cut], ids[:cut], hot, large))
            h, ids = h[cut:], ids[cut:]
            if len(h) > hot or (len(h) and h[0] == large):
                large = h[0]
                yield out(ids, ids, h)
                h, ids = h[:0], ids[:0]
        yield out(*run_pairs(h, ids, hot, large))

    found = materialize(rows.repartition("h").sortWithinPartitions("h").mapInArrow(go, "a long, b long, h long"), "buckets")
    large = found.filter("a = b").select("h", F.col("a").alias("id"))
    left = large.select("h", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    right = large.select("h", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("salt"))
    return found.filter("a < b").select("a", "b").unionByName(left.join(right, ["h", "salt"]).filter("a < b").select("a", "b")).distinct()


def _verified(pairs: DataFrame, units: Callable, k: int, least: float) -> DataFrame:
    """(a, b, j) of (a, b, text_a, text_b) whose Jaccard similarity is ``least`` or more, from all shingles of both, as 64-bit hashes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = WordHashes(), {}  # a text stands in several pairs, which come together for one of the two

        def grams(i: int, t: str) -> np.ndarray:
            if (x := known.get(i)) is None:
                if len(known) > 8000:
                    known.clear()
                x = known[i] = np.unique(shingles([t], units, k, words)[0])
            return x

        for b in batches:
            rows = []
            for i, j, s, t in zip(*(c.to_pylist() for c in b.columns)):
                x, y = grams(i, s), grams(j, t)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                z = np.sort(np.concatenate([x, y]))
                both = int((z[1:] == z[:-1]).sum())
                if both and both >= least * (len(x) + len(y) - both):
                    rows.append((i, j, both / (len(x) + len(y) - both)))
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "j"])

    return pairs.mapInArrow(go, "a long, b long, j double")


def near_duplicates(df: DataFrame, units: Callable = word_units, k: int = 5, least: float = 0.8, n_bands: int = 32, n_rows: int = 4, common: float | None = 0.002) -> tuple[DataFrame, DataFrame]:
    """Of (id, text), id unique: (a, b, j) between class representatives, and the membership (id, rep).

    A class holds the records of one text after case and white space are levelled; so copies, however many, are compared once.
    NULL ids, NULL, blank and too short texts are in no class. Repeated rows count once; no rows give no rows.
    The chance to miss a pair whose shingles' probability Jaccard similarity is j is (1 - j ** n_rows) ** n_bands; for shingles of one
    weight that is their Jaccard similarity. Shingles that occur more than ``common`` times as often as there are records weigh less (none do if it is None), or pages of one site would meet by
    its template. What is returned is verified: the exact Jaccard similarity of the sets is ``least`` or more.
    """
    level = materialize(levelled(spread(df), units, k, common is not None), "levelled")
    often = None if common is None else common_cells(level, common)
    level = level.filter("id is not null")
    member = level.select("id", "sha").distinct()
    reps = member.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = materialize(member.join(reps.filter("n > 1"), "sha").select("id", "rep"), "copies")
    membership = member.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    # the texts of the representatives; repeated rows of one id go by the pairs being distinct
    texts = level.select("id", F.col("level").alias("text")).join(small(copies.filter("id <> rep").select("id")), "id", "left_anti")
    cand = materialize(bucket_pairs(bands(spread(texts), units, k, n_bands, n_rows, often)), "pairs")
    texts = texts.join(small(cand.select(F.col("a").alias("id")).union(cand.select("b")).distinct()), "id", "left_semi").dropDuplicates(["id"])
    pairs = cand.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    return _verified(pairs.select("a", "b", "text_a", "text_b"), units, k, least), membership


def expanded(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller id first, of all records of linked or equal classes."""
    m = membership
    links = pairs.select("a", "b").unionByName(m.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    x = links.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    return x.filter("a < b or x < y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


#: field -> table, text, units, shingle length, least similarity, bands, rows, share of common shingles
FIELDS = {
    "corpus.text": ("corpus", "text", word_units, 3, 0.5, 64, 4, 0.002),
    "corpus_audit.title": ("corpus_audit", "title", char_units, 3, 0.6, 32, 4, None),
}


def p4_found(spark, d: str) -> DataFrame:
    out = []
    for field, (t, col, units, *how) in FIELDS.items():
        df = table(spark, d, t).select(F.col("crawl_id").alias("id"), F.col(col).alias("text"))
        pairs, member = near_duplicates(df, units, *how)
        out.append(expanded(materialize(pairs, "pairs"), member).select(F.lit(field).alias("field"), "id_a", "id_b"))
    return out[0].unionByName(out[1])


def grouped(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, class_id, links): one row a record of a class; class_id: the least id of the records linked with it, links: to how many other texts."""
    labels = connected_components(pairs, "a", "b")
    degree = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    m = membership.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(degree, "rep", "left")
    return m.select("id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p4_groups(spark, d: str) -> DataFrame:
    """Each page and title with the group of its near copies."""
    out = []
    for field, (t, col, units, *how) in FIELDS.items():
        pairs, member = near_duplicates(table(spark, d, t).select(F.col("crawl_id").alias("id"), F.col(col).alias("text")), units, *how)
        out.append(grouped(materialize(pairs, "pairs"), member).select(F.lit(field).alias("field"), "id", "class_id", "links"))
    return out[0].unionByName(out[1])
