"""The most similar vectors of every vector: NN-descent by iterative joins.

Vectors of one direction (equal when normalised and rounded to 6 decimals) form a class and are searched as one, so copies,
however many, cost nothing twice. A forest of random projection trees gives each class its first neighbours; each
round of NN-descent then sends every class to its nearest neighbours, where all that meet are compared. In these steps vectors
travel as 16-bit components, which is exact to about 3e-5; where that could change the result, and for classes of several
vectors, the cosine is computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, table

#: Vectors that decide where the trees divide: a sample of about this many, or of 8 for each leaf if that is more, drawn by hash. All vectors are indexed.
FIT = 16384
#: Levels fitted on the sample, so at most 65,536 vectors. Larger leaves are divided further by their own members.
DEPTH = 13
SCALE = 32767.0
UNSURE = 1e-4


def _usable(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    ok = (F.size(vec) == dim) & F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))
    return df.select(F.col(key).alias("id"), F.col(vec).alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ok)


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    x = np.asarray(col.flatten(), dtype=np.float64)
    return x.reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _decode(col: pa.Array) -> np.ndarray:
    b = col.to_pylist()
    return (np.frombuffer(b"".join(b), np.int16).reshape(len(b), -1) / np.float32(SCALE)).astype(np.float32)


def keyed(usable: DataFrame, coded: bool) -> DataFrame:
    """(cls, id), with the 16-bit components q or else with vec. cls: an even number, a hash of the class."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_matrix(b.column(1), b.num_rows))
            r = np.round(x, 6) + 0.0
            cls = np.array([xxhash.xxh3_64_intdigest(row.tobytes()) for row in r], np.uint64).view(np.int64) & ~np.int64(1)
            if coded:
                q = np.round(x * SCALE).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([row.tobytes() for row in q], pa.binary())], names=["cls", "q"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(cls), b.column(0), b.column(1)], names=["cls", "id", "vec"])

    kind = dict(usable.dtypes)
    return usable.mapInArrow(go, "cls long, q binary" if coded else f"cls long, id {kind['id']}, vec {kind['vec']}")


def grow_trees(sample: np.ndarray, n_trees: int, depth: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Planes (trees x nodes x dim) and offsets: each node divides its part of the sample at the median along two members' difference."""
    rng = np.random.default_rng(seed)
    planes = np.zeros((n_trees, max(1, 2**depth - 1), sample.shape[1] if sample.ndim > 1 else 1), np.float32)
    offsets = np.zeros(planes.shape[:2], np.float32)
    for t in range(n_trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(2**level):
                part = sample[node == k]
                if len(part) > 1:
                    a, b = part[rng.choice(len(part), 2, replace=False)]
                    planes[t, first + k], offsets[t, first + k] = a - b, np.median(part @ (a - b))
            node = 2 * node + ((sample * planes[t, first + node]).sum(axis=1) > offsets[t, first + node])
    return planes, offsets


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(x) - 1)
    at, sim = np.empty((len(x), k), np.int64), np.empty((len(x), k), np.float32)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -9
        at[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
        sim[i : i + 1024] = np.take_along_axis(s, at[i : i + 1024], 1)
    return at, sim


def forest(vectors: DataFrame, n: int, n_trees: int, leaf: int):
    """(planes, offsets) of trees with about ``leaf`` of n classes a leaf, but of DEPTH levels at most, as a broadcast."""
    depth = int(np.clip(round(np.log2(max(1, n) / leaf)), 0, DEPTH))
    share = min(1.0, max(FIT, 8 << depth) / max(1, n))
    sample = [bytes(r.q) for r in vectors.filter(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("q").collect()] if depth else []
    dim = len(sample[0]) // 2 if sample else 1
    planes, offsets = grow_trees(np.frombuffer(b"".join(sample), np.int16).reshape(-1, dim).astype(np.float32) / np.float32(SCALE), n_trees, depth)
    return vectors.sparkSession.sparkContext.broadcast((depth, planes, offsets))


def routed(rows: DataFrame, key: str, kept) -> DataFrame:
    """(leaf, key, q) of (key, q): its leaf in each tree."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, planes, offsets = kept.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _decode(b.column(1))
            for t in range(len(planes)):
                node = np.zeros(len(x), np.int64)
                for level in range(depth):
                    at = 2**level - 1 + node
                    dots = np.take_along_axis(x @ planes[t, 2**level - 1 : 2 ** (level + 1) - 1].T, node[:, None], 1)[:, 0] if level < 7 else (x * planes[t, at]).sum(axis=1)
                    node = 2 * node + (dots > offsets[t, at])
                yield pa.RecordBatch.from_arrays([pa.array((t << 40) + node), b.column(0), b.column(1)], names=["leaf", key, "q"])

    return rows.select(key, "q").mapInArrow(route, f"leaf long, {key} {dict(rows.dtypes)[key]}, q binary")


def divided(x: np.ndarray, most: int, seed: int) -> list[np.ndarray]:
    """Places of x in parts of at most ``most``, halved along the difference of two members as the trees are."""
    rng = np.random.default_rng(seed)
    todo, done = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        a, b = x[part[rng.choice(len(part), 2, replace=False)]]
        part = part[np.argsort(x[part] @ (a - b), kind="stable")]
        todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    return done


def forest_lists(vectors: DataFrame, n: int, n_trees: int, leaf: int, k: int) -> DataFrame:
    """(cls, nb, sim): for each tree the k nearest classes of the same leaf. A leaf of more than four times ``leaf`` is divided by its own members."""

    def search(g: pa.Table) -> pa.Table:
        g = g.combine_chunks()
        cls, x = g.column("cls").to_numpy(), _decode(g.column("q"))
        parts = [(p, *_nearest(x[p], k)) for p in (divided(x, 2 * leaf, g.column("leaf")[0].as_py()) if len(x) > 4 * leaf else [np.arange(len(x))])]
        own = np.concatenate([p for p, _, _ in parts])
        nb = np.concatenate([cls[p][at].reshape(-1) for p, at, _ in parts])
        sim = np.concatenate([s.reshape(-1) for _, _, s in parts])
        ends = pa.array(np.append(0, np.cumsum(np.concatenate([np.full(len(p), at.shape[1]) for p, at, _ in parts]))).astype(np.int32))
        return pa.table({"cls": cls[own], "nb": pa.ListArray.from_arrays(ends, pa.array(nb)), "sim": pa.ListArray.from_arrays(ends, pa.array(sim))})

    return routed(vectors, "cls", forest(vectors, n, n_trees, leaf)).groupBy("leaf").applyInArrow(search, "cls long, nb array<long>, sim array<float>")


def best_lists(lists: DataFrame, keep: int, k: int) -> DataFrame:
    """(cls, nb, sim, fresh): of all lists (cls, nb, sim, new) of a class, a bounded number, the ``keep`` nearest different classes, nearest first. fresh: how many of the first k only a new list has."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = np.asarray(b.column(1).value_lengths())
            own, nb, sim, new = np.repeat(np.arange(b.num_rows), n), np.asarray(b.column(1).flatten()), np.asarray(b.column(2).flatten()), np.asarray(b.column(3).flatten())
            order = np.lexsort((new, -sim, nb, own))
            own, nb, sim, new = own[order], nb[order], sim[order], new[order]
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]) | (nb[1:] != nb[:-1])
            own, nb, sim, new = own[first], nb[first], sim[first], new[first]
            order = np.lexsort((nb, -sim, own))
            own, nb, sim, new = own[order], nb[order], sim[order], new[order]
            count = np.bincount(own, minlength=b.num_rows)
            place = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            fresh = np.bincount(own[place < k], new[place < k], minlength=b.num_rows)
            nb, sim = nb[place < keep], sim[place < keep]
            ends = pa.array(np.append(0, np.cumsum(np.minimum(count, keep))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(nb)), pa.ListArray.from_arrays(ends, pa.array(sim)), pa.array(fresh.astype(np.int32))], names=["cls", "nb", "sim", "fresh"])

    rows = lists.select("cls", "nb", "sim", F.array_repeat(F.col("new").cast("byte"), F.size("nb")).alias("new"))
    joined = rows.groupBy("cls").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("nb", "sim", "new")))
    return joined.mapInArrow(go, "cls long, nb array<long>, sim array<float>, fresh int")


def descent_round(graph: DataFrame, vectors: DataFrame, k: int, width: int, turn: int = 0, place: int = 8192) -> DataFrame:
    """Better neighbours found where classes meet: (cls, nb, sim) rows of one neighbour each list.

    Each class goes to its ``width`` nearest; those that meet at one class, with it, are compared, all with all, and
    what is nearer than the k-th neighbour so far and not yet known is kept. A class that more than ``place`` others name is a meeting place in parts
    of that size, other parts in each round; what meets in none of them is found by way of other classes, or not.
    """
    at_k = F.coalesce(F.get("sim", F.lit(k - 1)), F.lit(-2.0).cast("float"))
    known = graph.join(vectors, "cls").select("cls", "q", at_k.alias("least"), "nb")
    marks = F.transform("nb", lambda x: F.pmod(F.shiftright(x, 7), F.lit(65536)).cast("int"))
    sent = known.select("cls", "q", "least", marks.alias("known"), F.explode(F.concat(F.array("cls"), F.slice("nb", 1, width))).alias("at"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def meet(b: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
            cls, least, x = b.column(1).to_numpy(), b.column(3).to_numpy(), _decode(b.column(2))
            n = np.asarray(b.column(4).value_lengths())
            marks = np.full((len(cls), int(n.max(initial=1))), -1, np.int64)
            marks[np.repeat(np.arange(len(cls)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(b.column(4).flatten())
            own = (cls >> 7) & 65535
            found: list[tuple] = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                for i in range(s, e if e - s > 1 else s, 1024):
                    for j in range(s, e, 1024):
                        sim = x[i : min(e, i + 1024)] @ x[j : min(e, j + 1024)].T
                        u, v = np.nonzero(sim > least[i : min(e, i + 1024), None])
                        near, u, v = sim[u, v], u + i, v + j
                        ok = (cls[u] != cls[v]) & ~(marks[u] == own[v][:, None]).any(axis=1)
                        found.append((cls[u[ok]], cls[v[ok]], near[ok]))
            u, v, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float32)))
            ends = pa.array(np.arange(len(u) + 1, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.ListArray.from_arrays(ends, pa.array(v)), pa.ListArray.from_arrays(ends, pa.array(s.astype(np.float32)))], names=["cls", "nb", "sim"])

        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            cuts = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
            if len(cuts) == 1 and b.num_rows < place:
                rest = b
                continue
            last = cuts[-1] if len(cuts) > 1 else b.num_rows
            rest = b.slice(last) if last < b.num_rows else None
            yield meet(b.slice(0, last), np.append(cuts[cuts < last], last))
        if rest is not None:
            yield meet(rest, np.array([0, rest.num_rows]))

    rows = sent.select("at", "cls", "q", "least", "known").repartition("at").sortWithinPartitions("at", F.xxhash64("cls", F.lit(turn)))
    found = rows.mapInArrow(go, "cls long, nb array<long>, sim array<float>")
    one = F.struct(F.get("sim", F.lit(0)).alias("s"), F.get("nb", F.lit(0)).alias("n"))
    flat = found.select("cls", one.alias("x")).distinct()
    w = Window.partitionBy("cls").orderBy(F.col("x.s").desc(), "x.n")
    return flat.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1).select("cls", F.array("x.n").alias("nb"), F.array("x.s").alias("sim"))


def lists_of(df: DataFrame, new: bool) -> DataFrame:
    return df.select("cls", "nb", "sim", F.lit(new).alias("new"))


def neighbour_graph(vectors: DataFrame, k: int = 5, keep: int = 11, n_trees: int = 4, leaf: int = 2048, width: int = 10, change: float = 0.02, rounds: int = 12) -> DataFrame:
    """(cls, nb, sim) of all classes: up to ``keep`` nearest, nearest first. vectors: (cls, q), cls unique.

    Rounds of NN-descent follow the forest until one changes no more than the share ``change`` of the first k neighbours of all classes, or after ``rounds``.
    """
    n = vectors.count()
    graph = materialize(best_lists(lists_of(forest_lists(vectors, n, n_trees, leaf, keep - 1), False), keep, k), "graph")
    for turn in range(rounds):
        better = descent_round(graph, vectors, k, width, turn)
        last, graph = graph, materialize(best_lists(lists_of(graph, False).unionByName(lists_of(better, True)), keep, k), "graph")
        discard(last)
        if (graph.agg(F.sum("fresh")).first()[0] or 0) <= change * k * n:
            break
    return graph.drop("fresh")


def nearest_pairs(df: DataFrame, key: str, vec: str, dim: int, k: int = 5, **how) -> DataFrame:
    """(a, b), a < b: vectors of which at least one is among the k nearest of the other, by cosine, then smaller key.

    Vectors that are NULL, all zero, of another length or with a NULL or NaN component take no part; nor do NULL keys. A repeated key
    counts once for each different vector. One vector or none gives no rows. About 19 of 20 true pairs are found; see the README.
    """
    usable = _usable(df, key, vec, dim)
    vectors = materialize(keyed(usable, True).groupBy("cls").agg(F.min("q").alias("q"), F.count(F.lit(1)).alias("n")).select((F.col("cls") + (F.col("n") > 1).cast("long")).alias("cls"), "q"), "vectors")
    graph = neighbour_graph(vectors, k, **how)
    several = lambda c: F.pmod(c, F.lit(2)) == 1
    near = F.slice("nb", 1, k + 1)
    gap = F.get("sim", F.lit(k - 1)) - F.coalesce(F.get("sim", F.lit(k)), F.lit(-2.0))
    slow = several(F.col("cls")) | F.exists(near, several) | (gap < UNSURE) | (F.size("nb") < k)
    graph = graph.withColumn("slow", F.coalesce(slow, F.lit(True)))
    fast = graph.filter("not slow").select("cls", F.explode(F.slice("nb", 1, k)).alias("nb"))
    fast = fast.select(F.least("cls", "nb").alias("x"), F.greatest("cls", "nb").alias("y")).distinct()
    even = lambda c: c - F.pmod(c, F.lit(2))
    own = keyed(usable, False)
    ids = own.select("cls", "id")
    by_id = fast.join(ids.withColumnsRenamed({"cls": "x", "id": "id_x"}), "x").join(ids.withColumnsRenamed({"cls": "y", "id": "id_y"}), "y").select("id_x", "id_y")
    # the classes that need exact cosines: up to k + 1 vectors of each near class, the smallest keys, serve all their vectors
    todo = graph.filter("slow").select(even(F.col("cls")).alias("cls"), F.explode(F.concat(F.array("cls"), "nb")).alias("nb")).select("cls", even(F.col("nb")).alias("nb"))
    w = Window.partitionBy("cls").orderBy("id")
    firsts = own.join(todo.select(F.col("nb").alias("cls")).distinct(), "cls", "left_semi").dropDuplicates(["cls", "id"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k + 1)
    firsts = materialize(firsts.select(F.col("cls").alias("nb"), F.col("id").alias("id_y"), F.col("vec").alias("vec_y")), "firsts")
    full = firsts.groupBy("nb").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == k + 1).select(F.col("nb").alias("cls"))
    todo = todo.filter("cls = nb").unionByName(todo.filter("cls <> nb").join(full, "cls", "left_anti"))
    members = own.join(todo.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls", "id"])
    pairs = members.join(todo, "cls").join(firsts, "nb").filter(F.col("id") != F.col("id_y")).select("id", "id_y", "vec", "vec_y")

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = (_unit(_matrix(b.column(2), b.num_rows)) * _unit(_matrix(b.column(3), b.num_rows))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(c, 6))], names=["id_x", "id_y", "cos"])

    kind = dict(usable.dtypes)["id"]
    by = Window.partitionBy("id_x").orderBy(F.col("cos").desc(), "id_y")
    exact = pairs.mapInArrow(cosines, f"id_x {kind}, id_y {kind}, cos double").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k).select("id_x", "id_y")
    return by_id.unionByName(exact).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def embedding_dim(spark, d: str) -> int:
    """The length from sbert_config, a table of one row."""
    return table(spark, d, "sbert_config").agg(F.max("embedding_dim")).first()[0] or 0


def p6_found(spark, d: str) -> DataFrame:
    return nearest_pairs(table(spark, d, "chunks"), "chunk_id", "embedding", embedding_dim(spark, d)).withColumnsRenamed({"a": "chunk_a", "b": "chunk_b"})


def adjacency(graph: DataFrame, keep: int = 11) -> DataFrame:
    """(cls, nb): neighbours of each class and, of the classes that name it, the ``keep`` nearest; one row an edge."""
    e = graph.select("cls", F.explode(F.arrays_zip("nb", "sim")).alias("e")).select("cls", F.col("e.nb").alias("nb"), F.col("e.sim").alias("sim"))
    w = Window.partitionBy("nb").orderBy(F.col("sim").desc(), "cls")
    back = e.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep).select(F.col("nb").alias("cls"), F.col("cls").alias("nb"))
    return e.select("cls", "nb").unionByName(back).distinct()


def _similar(rows: DataFrame, kind: str) -> DataFrame:
    """(qid, cls, sim) of (qid, cls, q, v)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (_decode(b.column(2)) * _decode(b.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float64))], names=["qid", "cls", "sim"])

    return rows.select("qid", "cls", "q", "v").mapInArrow(go, f"qid {kind}, cls long, sim double")


def graph_search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = 24, n_trees: int = 4, leaf: int = 2048, hops: int = 24) -> DataFrame:
    """(qid, cls, sim, rank): greedy search of the graph for each of (qid, q), q as in vectors.

    From the nearest classes of its leaf in each tree of a projection forest, as the graph need not be connected, each hop takes the best ``beam`` met so far, follows those not followed yet, and
    ends when no query has any, or after ``hops``. No queries or an empty graph give no rows.
    """
    kind = dict(queries.dtypes)["qid"]
    edges = materialize(adjacency(graph), "edges")
    w = Window.partitionBy("qid").orderBy(F.col("sim").desc(), "cls")
    best = lambda df: df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= beam).drop("_n")

    def first(asked: pa.Table, held: pa.Table) -> pa.Table:
        qid, cls = asked.column("qid").combine_chunks(), held.column("cls").to_numpy()
        if not len(qid) or not len(cls):
            return pa.table({"qid": qid.slice(0, 0), "cls": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        u, x, n = _decode(asked.column("q")), _decode(held.column("q")), min(beam, len(cls))
        at, sim = np.empty((len(u), n), np.int64), np.empty((len(u), n))
        for i in range(0, len(u), 1024):
            s = u[i : i + 1024] @ x.T
            at[i : i + 1024] = np.argpartition(-s, n - 1, axis=1)[:, :n]
            sim[i : i + 1024] = np.take_along_axis(s, at[i : i + 1024], 1)
        return pa.table({"qid": qid.take(pa.array(np.repeat(np.arange(len(u)), n))), "cls": cls[at.reshape(-1)], "sim": sim.reshape(-1)})

    kept = forest(vectors, vectors.count(), n_trees, leaf)
    starts = routed(queries, "qid", kept).groupBy("leaf").cogroup(routed(vectors, "cls", kept).groupBy("leaf")).applyInArrow(first, f"qid {kind}, cls long, sim double")
    state = materialize(best(starts.groupBy("qid", "cls").agg(F.max("sim").alias("sim")).withColumn("done", F.lit(False))), "state")
    for _ in range(hops):
        met = state.filter("not done").join(edges, "cls").select("qid", F.col("nb").alias("cls")).distinct().join(state, ["qid", "cls"], "left_anti")
        new = _similar(met.join(vectors.select("cls", F.col("q").alias("v")), "cls").join(queries, "qid"), kind).withColumn("done", F.lit(False))
        last, state = state, materialize(best(state.withColumn("done", F.lit(True)).unionByName(new)), "state")
        discard(last)
        if not state.filter("not done").head(1):
            break
    return state.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "cls", "sim", "rank")


def p6_search(spark, d: str, k: int = 5) -> DataFrame:
    """Chunks, one in twenty by the hash of their id, looked up in the graph of all: the first chunk of each class found, but of their own."""
    usable = _usable(table(spark, d, "chunks"), "chunk_id", "embedding", embedding_dim(spark, d))
    vectors = materialize(keyed(usable, True).groupBy("cls").agg(F.min("q").alias("q")), "vectors")
    ids = keyed(usable, False).select("cls", "id")
    mine = ids.filter(F.pmod(F.xxhash64("id"), F.lit(20)) == 0)
    queries = materialize(mine.join(vectors, "cls").select(F.col("id").alias("qid"), "q").dropDuplicates(["qid"]), "queries")
    found = graph_search(neighbour_graph(vectors), vectors, queries, k + 1).join(mine.select(F.col("id").alias("qid"), F.col("cls").alias("own")), "qid").filter("cls <> own")
    named = found.join(ids.groupBy("cls").agg(F.min("id").alias("chunk_id")), "cls")
    w = Window.partitionBy("qid").orderBy("rank")
    return named.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("qid").alias("query_id"), "rank", "chunk_id", F.round("sim", 3).alias("cosine"))
