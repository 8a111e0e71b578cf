"""The k most similar vectors of every vector: NN-descent on a graph that space partitioning starts.

1. *Classes.* Vectors of one direction (equal after scaling to unit length) form a class; its representative is its
   smallest id. A class keeps its ``k + 1`` smallest ids: since equal similarities rank by id, no other member can be
   among anyone's k nearest. So a vector repeated a million times is one node, however the copies are spread.
2. *Start.* A few random-projection trees, fitted on a bounded sample (``sample_rows``), deal the nodes into small
   leaves; within a leaf all similarities are computed as one matrix product. Where the sample is too small to cut the
   leaves to ``leaf_rows``, further random projections do so before anything is shuffled; what then still exceeds
   ``leaf_cap`` is cut on where it lies, so no leaf's work is quadratic in the data.
3. *Descent.* Nodes that share a neighbour are compared: each node's list (forward and reverse) is a local join. The
   leaves of the first tree number the nodes, so a number's high bits name a *block* of nodes that lie together. Lists
   are dealt by block and travel as numbers; a node's vector travels once to each block that asks for it, and only
   pairs better than a node's worst neighbour come back. Reverse lists are dealt into parts of bounded size that each
   meet the whole forward list, so a hub with any number of admirers is many tasks and loses nobody. Rounds stop when
   fewer than ``delta`` of the neighbours changed.
4. *Members.* Classes are turned back into vectors and each vector's k nearest are ranked by similarity rounded to six
   places, then by id.

:func:`search` answers vectors that need not be in the table by greedy search over the finished graph.

Similarities are computed in double precision from the stored vectors throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.session import cut_lineage, drop_table, shuffle_width

PLACES = 6
#: places kept while lists are merged, so that one pair computed in two places is one entry
EXACT = 11


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list<float> column as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``id, v``: one row per key whose vector has ``dim`` finite numbers that are not all zero.

    Of rows with one key the one with the smallest vector stands for it, which only matters where they differ.
    """
    v = F.col(f"`{vector}`")
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & v.isNotNull()).where(fine)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), v.cast("array<float>").alias("v")).dropDuplicates(["id"])


def directions(rows: DataFrame, dim: int) -> DataFrame:
    """``id, v, d``: the rows with a digest of their direction, equal for vectors that differ in length only."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = np.rint(_matrix(batch.column(1), dim) * 1e6).astype(np.int32)
                unit += 0  # one zero
                keys = pa.array([r.tobytes() for r in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], ["id", "v", "d"])

    return rows.mapInArrow(digest, "id long, v array<float>, d binary").select("id", "v", F.md5("d").alias("d"))


#: a node's number: its block, the partition that numbered it, and its place there
BLOCK_SHIFT, PARTITION_SHIFT = 42, 26
MAX_BLOCKS = 1 << 21


class Forest:
    """Random-projection trees over unit vectors, as arrays: hyperplanes, offsets and leaves of a complete binary tree.

    ``rows`` says how many vectors will be dealt. Below the leaves that the sample can tell apart (eight of it each),
    ``extra`` levels cut by random directions at the median of the leaf's own sample, until leaves hold ``leaf_rows``.
    """

    def __init__(self, sample: np.ndarray, rows: int, trees: int, leaf_rows: int, seed: int) -> None:
        self.trees = []
        dim = sample.shape[1] if len(sample) else 1
        depth = 0
        while len(sample) / 2**depth > 16 and rows / 2**depth > leaf_rows:
            depth += 1
        self.extra = max(0, int(np.ceil(np.log2(max(rows, 1) / 2**depth / leaf_rows)))) if len(sample) else 0
        self.depth = depth
        for t in range(trees):
            rng = np.random.default_rng([seed, t])
            planes, offsets = np.zeros((2**depth, dim)), np.zeros(2**depth)
            where = np.ones(len(sample), dtype=np.int64)
            for level in range(depth):
                for node in range(2**level, 2 ** (level + 1)):
                    own = sample[where == node]
                    if len(own) >= 2:
                        a, b = own[rng.choice(len(own), 2, replace=False)]
                        plane = a - b
                        planes[node], offsets[node] = plane, np.median(own @ plane)
                    else:
                        planes[node] = rng.standard_normal(dim)
                where = where * 2 + (np.einsum("ij,ij->i", sample, planes[where]) > offsets[where])
            directions = rng.standard_normal((self.extra, dim))
            middles = np.zeros((2**depth, self.extra))
            if self.extra:
                order = np.argsort(where, kind="stable")
                for leaf, own in zip(*(lambda u, i: (u, np.split(order, i[1:])))(*np.unique(where[order], return_index=True))):
                    middles[leaf - 2**depth] = np.median(sample[own] @ directions.T, axis=0)
            self.trees.append((planes, offsets, directions, middles))

    def leaves(self, unit: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.empty((len(self.trees[:trees]), len(unit)), dtype=np.int64)
        for t, (planes, offsets, directions, middles) in enumerate(self.trees[:trees]):
            where = np.ones(len(unit), dtype=np.int64)
            for _ in range(self.depth):
                where = where * 2 + (np.einsum("ij,ij->i", unit, planes[where]) > offsets[where])
            leaf = where = where - 2**self.depth
            for j in range(self.extra):
                where = where * 2 + (unit @ directions[j] > middles[leaf, j])
            out[t] = where
        return out

    def shift(self, rows: int, block_rows: int) -> int:
        """By how many bits the first tree's leaves are shortened to blocks of about ``block_rows``."""
        levels = self.depth + self.extra
        return max(0, levels - min(max(0, int(np.log2(max(rows, 1) / block_rows))), MAX_BLOCKS.bit_length() - 1)) if rows > block_rows else levels


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best columns of ``sims``, as ids and similarities."""
    if sims.shape[1] > k:
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        best = np.tile(np.arange(sims.shape[1]), (len(sims), 1))
    return ids[best], np.take_along_axis(sims, best, 1)


def _cut(unit: np.ndarray, cap: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Index sets of at most ``cap`` rows, by further random projections at their median (halves by rank, so it ends)."""
    parts, out = [np.arange(len(unit))], []
    while parts:
        part = parts.pop()
        if len(part) <= cap:
            out.append(part)
            continue
        a, b = unit[part[rng.choice(len(part), 2, replace=False)]]
        order = part[np.argsort(unit[part] @ (a - b), kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


_LIST = "v long, n array<long>, s array<double>"


def _lists(ids: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    k = others.shape[1]
    offsets = pa.array(np.arange(0, (len(ids) + 1) * k, k, dtype=np.int32))
    n = pa.ListArray.from_arrays(offsets, pa.array(others.ravel().astype(np.int64)))
    s = pa.ListArray.from_arrays(offsets, pa.array(sims.ravel().astype(np.float64)))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), n, s], ["v", "n", "s"])


def _by_node(lists: DataFrame, k: int, schema: str, width: int) -> DataFrame:
    """Rows ``v, n, s, old`` (lists of nodes and similarities) as one list per ``v``: its k best without repeats.

    The lists meet in sorted partitions and are merged as flat arrays; a collecting aggregate in the JVM would sort
    them one object at a time. ``f`` says of each entry whether no ``old`` list has it.
    """

    def merged(v: np.ndarray, n: np.ndarray, s: np.ndarray, old: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((~old, n, v))
        v, n, s, old = v[order], n[order], s[order], old[order]
        keep = np.r_[True, (v[1:] != v[:-1]) | (n[1:] != n[:-1])] if len(v) else np.zeros(0, dtype=bool)
        v, n, s, old = v[keep], n[keep], s[keep], old[keep]
        order = np.lexsort((n, -s, v))
        v, n, s, old = v[order], n[order], s[order], old[order]
        begin = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=int)
        keep = np.arange(len(v)) - np.repeat(begin, np.diff(np.r_[begin, len(v)])) < k
        v, n, s, old = v[keep], n[keep], s[keep], old[keep]
        cuts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=int)
        offsets = pa.array(np.r_[cuts, len(v)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (n, s, ~old)]
        return pa.RecordBatch.from_arrays([pa.array(v[cuts]), *lists], ["v", "n", "s", "f"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            v, old = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), sizes) for i in (0, 3))
            n, s = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            held.append((v, n, s, old.astype(bool)))
            if len(v) and held[0][0][:1] != v[-1:]:
                v, n, s, old = (np.concatenate(x) for x in zip(*held))
                upto = int(np.searchsorted(v, v[-1]))  # the last node may go on in the next batch
                yield merged(v[:upto], n[:upto], s[:upto], old[:upto])
                held = [(v[upto:], n[upto:], s[upto:], old[upto:])]
        if held:
            yield merged(*(np.concatenate(x) for x in zip(*held)))

    rows = lists.select("v", "n", "s", "old").repartition(width, "v").sortWithinPartitions("v")
    return rows.mapInArrow(merge, schema)


_GRAPH = "v long, n array<long>, s array<double>, f array<boolean>"


def _merge_lists(lists: DataFrame, k: int) -> DataFrame:
    return _by_node(lists, k, _GRAPH, shuffle_width(lists.sparkSession) * 2)


def grow(nodes: DataFrame, dim: int, trees: int = 8, leaf_rows: int = 600, sample_rows: int = 20_000, seed: int = 5):
    """A broadcast forest for ``nodes`` (``id, v``), with their number. It has at most ``2 * sample_rows`` hyperplanes a tree."""
    n = nodes.count()
    sampled = nodes.orderBy(F.xxhash64("id", F.lit(seed))).limit(sample_rows).select("v").toPandas()["v"] if n else []
    sample = np.stack([np.asarray(x, dtype=np.float64) for x in sampled]) if len(sampled) else np.zeros((0, dim))
    if len(sample):
        sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return nodes.sparkSession.sparkContext.broadcast(Forest(sample, n, trees, leaf_rows, seed)), n


def numbered(nodes: DataFrame, dim: int, forest, n: int, block_rows: int = 2048) -> DataFrame:
    """``id, number`` of each node of a written table: numbers whose high bits name the node's block."""
    shift = forest.value.shift(n, block_rows)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << PARTITION_SHIFT
        for batch in batches:
            if batch.num_rows:
                blocks = forest.value.leaves(_matrix(batch.column(1), dim), 1)[0] >> shift
                numbers = (blocks << BLOCK_SHIFT) | np.arange(at, at + batch.num_rows)
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers)], ["id", "number"])

    return nodes.select("id", "v").mapInArrow(number, "id long, number long")


def knn_graph(nodes: DataFrame, dim: int, k: int, forest, n: int, leaf_cap: int = 1500, rounds: int = 6, delta: float = 0.02, join_k: int = 10, part: int = 48, seed: int = 5, report: list | None = None) -> DataFrame:
    """The graph ``v, n, s, f`` of distinct directions: each node's k nearest found (fewer where there are fewer nodes).

    ``nodes``: ``id, v``, written by the caller, ``id`` as :func:`numbered` gives it. ``report`` collects the number of
    new entries of each round.
    """
    spark = nodes.sparkSession
    width = shuffle_width(spark)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = forest.value.leaves(_matrix(batch.column(1), dim))
                for t, row in enumerate(leaves):
                    tree = pa.array(np.full(batch.num_rows, t, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([tree, pa.array(row), batch.column(0), batch.column(1)], ["tree", "leaf", "id", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ids: np.ndarray, unit: np.ndarray, key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            for rows in _cut(unit, leaf_cap, np.random.default_rng([seed, *key])):
                if len(rows) < 2:
                    continue
                own = unit[rows]
                sims = np.round(own @ own.T, EXACT)
                np.fill_diagonal(sims, -2.0)
                others, best = _top(sims, ids[rows], min(k, len(rows) - 1))
                yield _lists(ids[rows], others, best)

        for key, ids, unit in _groups(batches, dim, ("tree", "leaf")):
            yield from close(ids, unit, key)

    planted = nodes.select("id", "v").mapInArrow(plant, "tree int, leaf long, id long, v array<float>")
    leaves = planted.repartition(width * 2, "tree", "leaf").sortWithinPartitions("tree", "leaf")
    graph = cut_lineage(_merge_lists(leaves.mapInArrow(compare, _LIST).withColumn("old", F.lit(False)), k))
    for _ in range(rounds):
        before = graph
        graph, changed = _descend(graph, nodes, dim, k, join_k, part, width)
        drop_table(before)
        if report is not None:
            report.append(changed)
        if changed <= delta * k * max(n, 1):
            break
    return graph


def _groups(batches: Iterator[pa.RecordBatch], dim: int, keys: tuple[str, ...]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Runs of equal ``keys`` in sorted batches, each as (key, ids, unit vectors)."""
    held: list = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        ks = np.stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        ids = batch.column(names.index("id")).to_numpy(zero_copy_only=False)
        unit = _matrix(batch.column(names.index("v")), dim)
        cuts = np.flatnonzero((ks[1:] != ks[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            key = tuple(ks[a].tolist())
            if key != current and held:
                yield current, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held = []
            current = key
            held.append((ids[a:b], unit[a:b]))
    if held:
        yield current, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def _descend(graph: DataFrame, nodes: DataFrame, dim: int, k: int, join_k: int, part: int, width: int) -> tuple[DataFrame, int]:
    """One round: local joins around every node whose list has new entries. Returns the graph and its number of new entries.

    Pairs of which neither entry is new were compared in an earlier round and are left out, and so are lists without
    a new entry. The ``join_k`` nearest of each list take part; a node that is among another's nearest takes part in
    its list in any case.
    """
    worst = F.when(F.size("s") >= k, F.element_at("s", -1)).otherwise(F.lit(-2.0))
    known = graph.select(F.col("v").alias("id"), worst.alias("w"))
    edges = graph.select("v", F.explode(F.slice(F.arrays_zip("n", "f"), 1, join_k)).alias("e")).select("v", F.col("e.n").alias("n"), F.col("e.f").alias("new"))
    # u's list: its neighbours (forward), and the nodes that have u as a neighbour (reverse), in parts
    forward = edges.select(F.col("v").alias("u"), F.col("n").alias("id"), F.lit(True).alias("f"), "new")
    reverse = edges.select(F.col("n").alias("u"), F.col("v").alias("id"), F.lit(False).alias("f"), "new")
    lists = forward.unionByName(reverse).groupBy("u", "id").agg(F.max("f").alias("f"), F.max("new").alias("new"))
    about = lists.groupBy("u").agg(F.count_if(~F.col("f")).alias("c"), F.max("new").alias("any")).where("any").select("u", F.greatest(F.ceil(F.col("c") / part).cast("int"), F.lit(1)).alias("parts"))
    listed = lists.join(about, "u")
    one = F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = listed.withColumn("part", F.explode(F.when(F.col("f"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(one)))
    members = members.select(F.shiftright("u", BLOCK_SHIFT).cast("int").alias("block"), "part", "u", "id", "f", "new")
    asked = members.select("block", "part", "id").distinct().join(nodes.select("id", "v").join(known, "id"), "id")
    lone = lambda kind: F.lit(None).cast(kind)
    rows = asked.select("block", "part", lone("bigint").alias("u"), "id", lone("boolean").alias("f"), lone("boolean").alias("new"), "w", "v")
    rows = rows.unionByName(members.select("block", "part", "u", "id", "f", "new", lone("double").alias("w"), lone("array<float>").alias("v")))
    rows = rows.repartition(width * 2, "block", "part").sortWithinPartitions("block", "part", F.asc_nulls_first("u"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, unit, worst, lists in _blocks(batches, dim):
            place = np.argsort(ids)
            ids, unit, worst = ids[place], unit[place], worst[place]
            short, least = unit.astype(np.float32), (worst - 1e-6).astype(np.float32)
            u, member, fwd, new = lists
            at = np.searchsorted(ids, member)
            begin = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, dtype=int)
            sizes = np.diff(np.r_[begin, len(u)])
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def best(held=held, ids=ids, unit=unit, worst=worst) -> pa.RecordBatch:
                """Of the pairs found so far each once, and no more than a node's k best, with their exact similarity."""
                key, s = (np.concatenate(x) for x in zip(*held))
                held.clear()
                key, first = np.unique(key, return_index=True)
                a, b, s = key // len(ids), key % len(ids), s[first]
                order = np.lexsort((-s, a))
                a, b = a[order], b[order]
                cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                keep = np.arange(len(a)) - np.repeat(cuts, np.diff(np.r_[cuts, len(a)])) < k
                a, b = a[keep], b[keep]
                s = np.round(np.einsum("ij,ij->i", unit[a], unit[b]), EXACT)
                keep = s > worst[a] + 1e-12
                a, b, s = a[keep], b[keep], s[keep]
                cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=int)
                offsets = pa.array(np.r_[cuts, len(a)].astype(np.int32))
                return pa.RecordBatch.from_arrays([pa.array(ids[a[cuts]]), pa.ListArray.from_arrays(offsets, pa.array(ids[b])), pa.ListArray.from_arrays(offsets, pa.array(s))], ["v", "n", "s"])

            n_held = 0
            for some in _alike(sizes):
                # lists of about one length at a time, as one stack of matrices in single precision
                wide = int(sizes[some].max())
                take = begin[some][:, None] + np.minimum(np.arange(wide), sizes[some][:, None] - 1)
                there = np.arange(wide) < sizes[some][:, None]
                rows = at[take]
                own = short[rows]
                sims = own @ own.transpose(0, 2, 1)
                f, w = fwd[take] & there, new[take] & there
                better = sims > np.where(there, least[rows], 9)[:, :, None]
                better &= f[:, :, None] | (f[:, None, :] & there[:, :, None])
                better &= (w[:, :, None] | w[:, None, :]) & there[:, None, :]
                better &= rows[:, :, None] != rows[:, None, :]
                g, a, b = np.nonzero(better)
                if len(g):
                    held.append((rows[g, a] * len(ids) + rows[g, b], sims[g, a, b]))
                    n_held += len(g)
                    if n_held > 2_000_000:
                        yield best()
                        n_held = 0
            if held:
                yield best()

    proposed = rows.mapInArrow(join, _LIST).withColumn("old", F.lit(False))
    merged = cut_lineage(_merge_lists(graph.select("v", "n", "s", F.lit(True).alias("old")).unionByName(proposed), k))
    return merged, merged.agg(F.sum(F.size(F.filter("f", lambda x: x)))).first()[0] or 0


def _alike(sizes: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """The lists in runs of about one length whose pairs are some ``cells`` in number."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and upto - at < 512 and int(sizes[order[upto]]) ** 2 * (upto - at + 1) <= cells:
            upto += 1
        yield order[at:upto]
        at = upto


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """Each (block, part) of sorted batches: the nodes it asked for (ids, unit vectors, worst similarities) and its lists."""
    current, nodes, lists = None, [], []

    def gathered() -> tuple:
        ids, unit, worst = (np.concatenate(x) for x in zip(*nodes))
        return ids, unit, worst, tuple(np.concatenate(x) for x in zip(*lists))

    for batch in batches:
        if not batch.num_rows:
            continue
        block, part = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(block)]):
            key = (block[a], part[a])
            if key != current and nodes and lists:
                yield gathered()
            if key != current:
                nodes, lists = [], []
            current = key
            own = batch.slice(a, b - a)
            first = own.column(2).null_count  # rows of nodes come before rows of lists
            if first:
                part_rows = own.slice(0, first)
                nodes.append((part_rows.column(3).to_numpy(zero_copy_only=False), _matrix(part_rows.column(7), dim), part_rows.column(6).to_numpy(zero_copy_only=False)))
            if first < own.num_rows:
                rest = own.slice(first)
                u, ids, fwd, new = (rest.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
                lists.append((u, ids, fwd.astype(bool), new.astype(bool)))
    if nodes and lists:
        yield gathered()


def most_similar(vectors: DataFrame, key: str = "vec_id", vector: str = "vector", dim: int = 64, k: int = 10, slack: int = 4, **settings) -> DataFrame:
    """Each usable vector's k most similar others: ``id, neighbour, similarity, rank``.

    Similarity is the cosine rounded to six places; equal ones rank by smaller id. Vectors of another length, with a
    null, an infinite or no number, or all zero are not usable; each key counts once; null keys are left out. With
    fewer than k + 1 usable vectors every vector has the others.
    """
    rows = cut_lineage(directions(usable(vectors, key, vector, dim), dim))
    # the limit applies before the shuffle, so a class that holds a third of all rows sends k + 1 of them per task
    first = Window.partitionBy("d").orderBy("id")
    kept = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    grouped = cut_lineage(kept.groupBy("d").agg(F.array_sort(F.collect_list("id")).alias("members"), F.min(F.struct("id", "v")).alias("r")).select("d", "members", F.col("r.id").alias("id"), F.col("r.v").alias("v")))
    forest, n = grow(grouped, dim, **{s: settings.pop(s) for s in ("trees", "leaf_rows", "sample_rows", "seed") if s in settings})
    classes = cut_lineage(grouped.join(numbered(grouped, dim, forest, n), "id").select("d", "members", F.col("number").alias("id"), "v"))
    graph = knn_graph(classes.select("id", "v"), dim, k + slack, forest, n, **settings)
    # the neighbours of a class as vectors: the members of near classes by similarity, then id
    near = graph.select("v", F.explode(F.arrays_zip("n", "s")).alias("p")).select("v", F.col("p.n").alias("n"), F.round("p.s", PLACES).alias("s"))
    near = near.join(classes.select(F.col("id").alias("n"), "members"), "n").select("v", "members", "s")
    every = near.unionByName(classes.select(F.col("id").alias("v"), "members", F.lit(1.0).alias("s")))
    alike = every.select("v", F.col("members").alias("n"), F.transform("members", lambda m: F.col("s")).alias("s"), F.lit(False).alias("old"))
    best = _by_node(alike, k + 1, _GRAPH, shuffle_width(rows.sparkSession) * 2)
    nearest = classes.join(best, classes["id"] == best["v"]).select("d", F.arrays_zip(F.transform(best["s"], lambda x: -x).alias("s"), best["n"].alias("n")).alias("p"))
    # one short list per class, sent to all members: a class of very many is dealt into parts of bounded size
    held = rows.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / 10_000).cast("int").alias("parts"))
    lists = nearest.join(held, "d").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = held.where("parts > 1")
    each = rows.select("id", "d").join(large, "d", "left").withColumn("salt", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).otherwise(0))
    each = each.select("id", "d", "salt").join(lists.select("d", "salt", "p"), ["d", "salt"])
    best = F.slice(F.array_sort(F.filter("p", lambda x: x["n"] != F.col("id"))), 1, k)
    ranked = each.select("id", F.posexplode(best).alias("rank", "x"))
    return ranked.select("id", F.col("x.n").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, least: float = 0.85, **settings) -> DataFrame:
    """Pairs ``vec_id_a < vec_id_b`` of similarity ``least`` or more of which one is among the other's k nearest."""
    near = most_similar(vectors, **settings).where(F.col("similarity") >= least)
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def links(graph: DataFrame, degree: int = 24) -> DataFrame:
    """``v, m``: the graph for searches: each node's ``degree`` best links, those to it included.

    A node that very many have as a neighbour is reached from each of them; of its own links back it keeps the best.
    The limit applies before the shuffle.
    """
    edges = graph.select("v", F.explode(F.arrays_zip("n", "s")).alias("e")).select("v", F.col("e.n").alias("m"), F.col("e.s").alias("s"))
    both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m"), "s")).distinct()
    best = both.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(F.col("s").desc(), "m"))).where(F.col("_n") <= degree)
    return cut_lineage(best.select("v", "m"))


def search(nodes: DataFrame, linked: DataFrame, forest, queries: DataFrame, dim: int, k: int = 10, beam: int = 40, expand: int = 4, per_leaf: int = 24, rounds: int = 40) -> DataFrame:
    """``q, n, s``: for each query (``q, v``, usable vectors) the k nearest nodes that greedy search over the graph finds.

    A search starts at some nodes of the leaves that the query falls into. In each round every query follows the links
    of the ``expand`` best nodes of its beam that it has not followed, and keeps the ``beam`` best nodes it has seen;
    it ends when it has followed all of them. All queries search at once: a round is a few equi joins.
    """
    asked = cut_lineage(queries.select("q", "v"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, row in enumerate(forest.value.leaves(_matrix(batch.column(1), dim))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, dtype=np.int32)), pa.array(row), batch.column(0)], ["tree", "leaf", "id"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.round(np.einsum("ij,ij->i", _matrix(batch.column(2), dim), _matrix(batch.column(3), dim)), EXACT)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], ["q", "n", "s"])

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(nodes.select(F.col("id").alias("n"), F.col("v").alias("_v")), "n").join(asked, "q")
        return rows.select("q", "n", "v", "_v").mapInArrow(similar, "q long, n long, s double")

    leaves = nodes.select("id", "v").mapInArrow(plant, "tree int, leaf long, id long")
    first = leaves.withColumn("_n", F.row_number().over(Window.partitionBy("tree", "leaf").orderBy(F.xxhash64("id"), "id"))).where(F.col("_n") <= per_leaf)
    own = asked.select(F.col("q").alias("id"), "v").mapInArrow(plant, "tree int, leaf long, id long").withColumnRenamed("id", "q")
    best = Window.partitionBy("q").orderBy(F.col("s").desc(), "n")
    open_ = Window.partitionBy("q").orderBy(F.col("followed"), F.col("s").desc(), "n")

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= beam).drop("_n")
        # the best that were not followed come first in this order
        return cut_lineage(rows.withColumn("next", ~F.col("followed") & (F.row_number().over(open_) <= expand)))

    state = kept(measured(own.join(first.select("tree", "leaf", F.col("id").alias("n")), ["tree", "leaf"]).select("q", "n").distinct()).withColumn("followed", F.lit(False)))
    for _ in range(rounds):
        if state.where("next").isEmpty():
            break
        ahead = state.where("next").select("q", F.col("n").alias("v")).join(linked, "v").select("q", F.col("m").alias("n")).distinct()
        fresh = measured(ahead.join(state.select("q", "n"), ["q", "n"], "left_anti")).withColumn("followed", F.lit(False))
        before = state
        state = kept(before.select("q", "n", "s", (F.col("followed") | F.col("next")).alias("followed")).unionByName(fresh))
        drop_table(before)
    return state.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("q", "n", "s")


def search_similar(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "vector", dim: int = 64, k: int = 10, **settings) -> DataFrame:
    """``query, neighbour, similarity, rank``: the k vectors nearest to each query vector, by greedy search over the graph.

    ``queries`` has the same columns and need not be part of ``vectors``; usable ones are answered, each key once. Equal
    directions are one node, and a node stands for its members by ascending id, at most k. Similarities are rounded to
    six places; equal ones rank by smaller id.
    """
    rows = directions(usable(vectors, key, vector, dim), dim)
    first = Window.partitionBy("d").orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    grouped = cut_lineage(few.groupBy("d").agg(F.array_sort(F.collect_list("id")).alias("members"), F.min(F.struct("id", "v")).alias("r")).select("members", F.col("r.id").alias("id"), F.col("r.v").alias("v")))
    forest, n = grow(grouped, dim)
    classes = cut_lineage(grouped.join(numbered(grouped, dim, forest, n), "id").select("members", F.col("number").alias("id"), "v"))
    graph = knn_graph(classes.select("id", "v"), dim, k + 4, forest, n, **settings)
    asked = usable(queries, key, vector, dim).select(F.col("id").alias("q"), "v")
    found = search(classes.select("id", "v"), links(graph), forest, asked, dim, k)
    each = found.join(classes.select(F.col("id").alias("n"), "members"), "n").select("q", F.explode("members").alias("neighbour"), F.round("s", PLACES).alias("similarity"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("similarity").desc(), "neighbour"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query"), "neighbour", "similarity", "rank")
