"""Which of similar items are redundant: components, greedy vertex cover, nearest neighbour."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from . import similar

#: Edges that one task may hold to end components, that it may have on its disk to end a cover, and those that a task
#: collects before it shrinks them.
TASK_EDGES, COVER_EDGES, HELD = 8_000_000, 500_000_000, 1_000_000


def _cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that the cluster shares; only a session of one machine may leave it unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("i", "j")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """id, component (smallest id) of every node of edges(i, j). Every task first shrinks its edges to stars, one edge for
    each node but the roots. What fits one task (most edges) ends there; else stars around the smallest neighbour, large
    and small in turn (Kiveris et al. 2014), until nothing changes."""

    def shrink(batches):
        held, new, most = [], 0, HELD
        for batch in batches:
            held.append([column.to_numpy() for column in batch.columns])
            new += batch.num_rows
            if new > most:
                held = [stars_of(*(np.concatenate(z) for z in zip(*held)))]
                new, most = 0, max(HELD, len(held[0][0]))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in stars_of(*(np.concatenate(z) for z in zip(*held)))], names=["a", "b"])

    stars = edges.select(F.greatest("i", "j").cast("long").alias("a"), F.least("i", "j").cast("long").alias("b")).where("i IS NOT NULL AND j IS NOT NULL AND i <> j")
    stars = _cut(stars.mapInArrow(shrink, "a long, b long"))
    if stars.count() <= most:
        stars = _cut(stars.repartition(1).mapInArrow(shrink, "a long, b long"))
    else:
        stars = _stars_in_rounds(_cut(stars.distinct()))
    roots = stars.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _stars_in_rounds(stars: DataFrame) -> DataFrame:
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = _cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        if not new.exceptAll(stars).limit(1).count() and not stars.exceptAll(new).limit(1).count():
            return stars
        stars = new


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that aren't the smallest of their component, and the smallest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        a, b = root[a], root[b]
        open_ = a != b
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (above := root[root])).any():
            root = above
    own = np.flatnonzero(root != np.arange(len(root)))
    return names[own], names[root[own]]


def greedy(edges: Iterable[tuple[int, int]]) -> list[int]:
    """Nodes of the cover that takes, again and again, the node with most uncovered edges, of equal ones the largest id."""
    both = np.array(list(edges), dtype=np.int64).reshape(-1, 2)
    return _greedy([(both[:, 0], both[:, 1])]).tolist()


def _greedy(parts: list[tuple[np.ndarray, np.ndarray]], rep=(), member=()) -> np.ndarray:
    """_greedy_packed() of arrays of edges."""
    parts = [(i[i != j], j[i != j]) for i, j in parts]
    return _greedy_packed([(np.asarray(rep, np.int64), np.asarray(member, np.int64)), *(numeric.packed(i, j, np.zeros(len(i), np.int32)) for i, j in parts)])


def _greedy_packed(packs: Iterable[Sequence[np.ndarray]]) -> np.ndarray:
    """greedy() of packs: edges as numeric.packed() gives them, and (rep, member). Nodes may stand for classes: rep[k] for
    member[k], or else for themselves; any two of a class have an edge, and all of one have one with all of the other if
    their nodes have.

    Classes lie by the number of their open edges, of a class the largest id. Numbers only fall, so none comes to those with
    most while these are gone through by id, and who has come down meanwhile is put where it belongs. Edges are in files without names, which end with
    the task; only what is of nodes is held in memory."""
    with tempfile.TemporaryFile() as flat:
        return _taken(*_neighbours(packs, flat))


def _neighbours(packs: Iterable[Sequence[np.ndarray]], flat) -> tuple[np.ndarray, ...]:
    """names, first, near, rep, member of packs: the nodes, and at first[k] to first[k + 1] in near the neighbours of the
    k-th, as places in names, in order and each once. near is in the file flat."""
    tables, none = [], np.zeros(0, np.int64)
    own = [(none, none)]
    with tempfile.TemporaryFile() as raw:
        for arrays in packs:
            if len(arrays) == 2:
                own.append(arrays)
            else:
                ids, _, count, near, _ = arrays
                raw.write(near)
                tables.append((ids.copy(), count.copy(), near.dtype))
        rep, member = (np.concatenate(z) for z in zip(*own))
        names = np.unique(np.concatenate([rep, *(ids for ids, _, _ in tables)]))
        first = np.zeros(len(names) + 1, np.int64)
        tables = [(np.searchsorted(names, ids).astype(np.int32), count, kind) for ids, count, kind in tables]
        for code, count, _ in tables:
            first[code + 1] += count
        first = np.cumsum(first)
        near = np.asarray(np.memmap(flat, np.int32, "w+", shape=(int(first[-1]),))) if first[-1] else none.astype(np.int32)
        free = first[:-1].copy()
        raw.seek(0)
        for code, count, kind in tables:
            part = np.frombuffer(raw.read(int(count.sum()) * kind.itemsize), kind)
            near[np.repeat(free[code] - (np.cumsum(count) - count), count) + np.arange(len(part))] = code[part]
            free[code] += count
    ends, again = first.tolist(), []
    for s, e in zip(ends, ends[1:]):
        if e - s > 1:
            near[s:e].sort()
    for at in range(0, len(near), HELD):
        few = near[at : at + HELD + 1]
        same = np.flatnonzero(few[1:] == few[:-1]) + at + 1
        again.append(same[first[np.searchsorted(first, same)] != same])
    again = np.concatenate([none, *again])
    if len(again):
        first, near = first - np.searchsorted(again, first), np.delete(near, again)
    return names, first, near, rep, member


def _taken(names: np.ndarray, first: np.ndarray, near: np.ndarray, rep: np.ndarray, member: np.ndarray) -> np.ndarray:
    """What _greedy_packed() takes, from what _neighbours() gives."""
    n = len(names)
    own = np.setdiff1d(names, rep)
    kind, ids = np.searchsorted(names, np.concatenate([rep, own])), np.concatenate([member, own])
    order = np.lexsort((ids, kind))
    kind, ids = kind[order], ids[order]
    once = np.concatenate([[True], (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])]) if len(ids) else np.zeros(0, bool)
    kind, ids = kind[once], ids[once]  # members by class, the largest last
    size = np.bincount(kind, minlength=n).astype(np.int32)
    degree, some = size.astype(np.int64) - 1, np.flatnonzero(np.diff(first))
    k, upto = 0, first[some + 1]
    while k < len(some):
        few = some[k : max(k + 1, np.searchsorted(upto, first[some[k]] + HELD))]
        k += len(few)
        degree[few] += np.add.reduceat(size[near[first[few[0]] : first[few[-1] + 1]]], first[few] - first[few[0]], dtype=np.int64)
    above, rank = np.unique(ids, return_inverse=True)
    end, start = np.cumsum(size), (np.cumsum(size) - size).tolist()
    ends = first.tolist()
    open_ = np.flatnonzero(degree > 0)
    order = open_[np.argsort(degree[open_])]
    cuts = [0, *(np.flatnonzero(np.diff(degree[order])) + 1).tolist(), len(order)]
    with_ = {int(degree[order[s]]): order[s:e].tolist() for s, e in zip(cuts, cuts[1:]) if e > s}
    left, out = [-d for d in with_], []
    heapq.heapify(left)

    def put(k, d):
        if d in with_:
            with_[d].append(k)
        elif d > 0:
            with_[d] = [k]
            heapq.heappush(left, -d)

    while left:
        d = -heapq.heappop(left)
        own = np.array(with_.pop(d))
        now = degree[own]
        for k, x in zip(own[now < d].tolist(), now[now < d].tolist()):
            put(k, x)
        own = own[now == d]
        for k in own[np.argsort(-rank[end[own] - 1])].tolist():
            if degree.item(k) == d:
                end[k] -= 1
                out.append(rank.item(end.item(k)))
                degree[k] -= 1
                degree[near[ends[k] : ends[k + 1]]] -= 1
                if end.item(k) == start[k]:
                    continue
            put(k, degree.item(k))
    return above[np.array(out, dtype=np.int64)]


def greedy_cover(edges: DataFrame, most: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """id of the redundant items: greedy()'s cover of edges(i, j), in rounds over all nodes at once.

    Each round takes every node that is above all of its neighbours, and the edges that these cover leave. What one task may
    have on its disk (most edges, of 12 bytes) ends there; larger graphs are spread over all tasks until little of them is left. Long chains of rising ids, and
    dense graphs, in which few nodes are above their neighbours, take many rounds. Null ends and loops are no edges; repeated edges are one.

    With members(id, rep), edges are those of classes, named by rep, and stand for all between their members; any two of
    a class have an edge too. The cover is that of all these edges, which are not made."""
    left = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("i IS NOT NULL AND j IS NOT NULL AND i <> j")
    return _cover(_cut(_packed(left)), COVER_EDGES if most is None else most, members)


def _packed(edges: DataFrame) -> DataFrame:
    def run(batches):
        ends = ([column.to_numpy() for column in batch.columns] for batch in batches)
        return similar.pack_edges((i, j, np.zeros(len(i), np.int32)) for i, j in ends)

    return edges.select("i", "j").mapInArrow(run, similar.PIECES)


def _cover(packs: DataFrame, most: int, members: DataFrame | None) -> DataFrame:
    """greedy_cover() of stored packs of edges without nulls and loops."""

    def pack_members(batches):
        return similar.pieces((0, tuple(column.to_numpy() for column in batch.columns)) for batch in batches)

    def end(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_greedy_packed(similar.read_packs(batches)))], names=["id"])

    taken, left, rounds = packs.sparkSession.createDataFrame([], "id long"), None, 0
    counted = packs.agg(F.sum("edges")).first()[0] or 0
    if members is not None:
        members = members.select(F.col("id").cast("long").alias("id"), F.col("rep").cast("long").alias("rep")).where("id IS NOT NULL AND rep IS NOT NULL").distinct()
    if counted > most:
        left = _cut(similar.unpacked(packs).distinct())
        if members is None:
            members = left.select(F.explode(F.array("i", "j")).alias("id")).distinct().withColumn("rep", F.col("id"))
        members = _cut(members)
    while counted > most:
        size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        both = left.unionByName(left.select(F.col("j").alias("i"), F.col("i").alias("j")))
        sums = both.join(size, both.j == size.rep).groupBy("i").agg(F.sum("n").alias("s"))
        rank = _cut(size.join(sums, size.rep == sums.i).select("rep", F.struct((F.col("s") + F.col("n")).alias("d"), "top").alias("own")))
        rivals = both.join(rank, both.j == rank.rep).groupBy("i").agg(F.max("own").alias("m"))
        won = rivals.join(rank, rivals.i == rank.rep).where("own > m").select("rep", F.when(F.col("own.d") == F.col("m.d"), F.col("m.top")).alias("below"))
        gone = _cut(members.join(won, "rep").where("below IS NULL OR id > below").select("id", "rep"))
        members = _cut(members.join(gone, ["id", "rep"], "left_anti"))
        empty = _cut(gone.select("rep").distinct().join(members, "rep", "left_anti"))
        left = _cut(left.join(empty, left.i == empty.rep, "left_anti").join(empty, F.col("j") == empty.rep, "left_anti"))
        taken = taken.unionByName(gone.select("id"))
        counted, rounds = left.count(), rounds + 1
    if members is not None:
        sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
        if rounds:  # classes without edges to others end apart
            linked = left.select(F.explode(F.array("i", "j")).alias("rep")).distinct()
            alone = members.join(linked, "rep", "left_anti").join(sizes, "rep").where("id > low")
            taken, members = taken.unionByName(alone.select("id")), members.join(linked, "rep", "left_semi")
        else:  # a class of one that stands for itself needs no row
            members = members.join(sizes.where("n > 1 OR low <> rep"), "rep", "left_semi")

    packs = packs if left is None else _cut(_packed(left))
    if members is not None:
        packs = packs.unionByName(_cut(members.select("rep", "id").mapInArrow(pack_members, similar.PIECES)))
    return taken.unionByName(packs.coalesce(1).mapInArrow(end, "id long"))


def nearest(edges: DataFrame) -> DataFrame:
    """id, neighbour, dist: the nearest neighbour of each node, of equally near ones the smallest id."""
    ends = F.array(*(F.struct(F.col(a).alias("id"), F.col("dist"), F.col(b).alias("n")) for a, b in ("ij", "ji")))
    both = edges.select(F.explode(ends).alias("e")).where("e.id IS NOT NULL")
    return both.groupBy("e.id").agg(F.min(F.struct("e.dist", "e.n")).alias("m")).select("id", F.col("m.n").alias("neighbour"), "m.dist")


def find_similar(hashes: DataFrame, threshold: int = 5, pairs: str = "exact", bits: int = 64, tables: int = 32, bits_per_table: int = 8) -> DataFrame:
    """id, path, similar_to, dist (and file_size) of what can go from hashes(id, path, w0, w1): every pair under the
    threshold loses at least one of its two."""
    keep = [c for c in ("file_size",) if c in hashes.columns]
    if pairs == "exact" and threshold > 0:
        # equal hashes are a class, whose members have the same neighbours, so only pairs of classes are made
        members = _cut(similar.classes(hashes))
        packs = _cut(similar.class_packs(members, threshold, bits))
        mates = members.groupBy("rep").agg(F.min(F.when(F.col("id") != F.col("rep"), F.col("id"))).alias("mate"))
        near = similar.nearest_packed(packs).select(F.col("id").alias("rep"), F.struct("dist", F.col("neighbour").alias("n")).alias("other"))
        mate = F.when(F.col("id") != F.col("rep"), F.col("rep")).otherwise(F.col("mate"))
        own = F.when(mate.isNotNull(), F.struct(F.lit(0).alias("dist"), mate.alias("n")))
        best = members.join(mates, "rep").join(near, "rep", "left").groupBy("id").agg(F.min(F.least(own, "other")).alias("m"))
        best = best.select("id", F.col("m.n").alias("neighbour"), F.col("m.dist").alias("dist"))
        gone = _cover(packs, COVER_EDGES, members)
    else:
        edges = _cut(similar.find_pairs(hashes, threshold, pairs, bits, tables, bits_per_table))
        best, gone = nearest(edges), greedy_cover(edges)
    other = hashes.select(F.col("id").alias("neighbour"), F.col("path").alias("similar_to"))
    out = gone.join(best, "id").join(hashes.select("id", "path", *keep), "id").join(other, "neighbour", "left")
    return out.select("id", "path", "similar_to", "dist", *keep)
