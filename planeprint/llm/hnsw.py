"""Embedding near-dedup with hierarchical navigable small-world graphs (Malkov and Yashunin 2016), one per shard.

Vectors with the same label and number of components form a family. Equal ones are one vertex with a count. A family is
dealt out into shards of bounded size; each gets a graph whose layers are drawn from hashes of the vertices, whose
edges lead to near vertices that are not nearer to one chosen before, and back. A vertex that its nearest one has no
room for hangs in a tree below that one, and one out of reach below the nearest within reach. Every vertex is then looked up in
every shard of its family (each pair of shards once, for both sides): greedily through the upper layers, with a beam in
the lowest one, and from what is near enough on to all its neighbours that are, so that a dense group is found as a
whole whatever the beam. A part of the queries is audited against brute force in the shard, and the beam is doubled
until the audit finds RECALL of all links; a beam beyond a part of the shard (WIDEST) becomes the whole shard, which is
brute force and finds them all. Pairs are verified by their cosine in double precision. A pair of shards returns sums of links and a spanning forest, never its pairs.

Vectors that are null, zero or hold null or non-finite components, and vectors without a label, link with nothing. Null
ids take part; rows that repeat an id are rows of their own that a result's id doesn't tell apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vertices of a shard, about; edges of a vertex each way; candidates that edges are chosen from; first beam.
SHARD, EDGES, CHOICE, BEAM = 3000, 12, 48, 32
#: Share of links that an audit must find, and queries that it takes of each pair of shards.
RECALL, AUDITED = 0.999, 256
#: The widest beam is the shard's size by this; beams expand their size by STEP vertices at once.
WIDEST, STEP = 8, 16
#: Most partitions that pairs of shards are dealt to.
MOST_PARTS = 100_000
#: Queries that move through a graph at once.
TOGETHER = 512

_ROWS = "vec_id long, label long, dim int, key binary, vector binary"
_SHARD = "label long, dim int, shard int, keys binary, counts binary, vectors binary, graph binary"


def _vertices(rows: DataFrame) -> DataFrame:
    """rows with the bytes of valid vectors in double precision and a key of them; without both otherwise."""

    def run(batches):
        for batch in batches:
            dims, keys, vectors = [], [], []
            for label, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = None
                if label is not None and x and all(c is not None for c in x):
                    v = np.array(x, np.float64) + 0.0  # no negative zeros
                    size = np.sqrt(np.dot(v, v))
                    if not (np.isfinite(v).all() and np.isfinite(size) and size > 0):
                        v = None
                dims.append(None if v is None else len(v))
                vectors.append(None if v is None else v.tobytes())
                keys.append(None if v is None else hashlib.blake2b(v.tobytes() + b"%d" % label, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "label", "dim", "key", "vector"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(common.lean(run), _ROWS)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


# --- the graph ------------------------------------------------------------------------------------------


def layers_of(keys: np.ndarray) -> np.ndarray:
    """The highest layer of each vertex, from its key."""
    u = (keys.view(np.uint8).reshape(-1, 16)[:, :8].copy().view(np.uint64).ravel() >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(EDGES)).astype(np.int64)


def chosen(u: np.ndarray) -> np.ndarray:
    """For each unit vector up to EDGES others: the nearest first, leaving out what is nearer to one chosen before."""
    n = len(u)
    k = min(CHOICE, n - 1)
    out = np.full((n, EDGES), -1, np.int32)
    for first in range(0, n if k > 0 else 0, TOGETHER):
        own = np.arange(first, min(n, first + TOGETHER))
        near = u[own] @ u.T
        near[np.arange(len(own)), own] = -2
        cand = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sims = np.take_along_axis(near, cand, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        count = np.zeros(len(own), np.int64)
        between = np.full((len(own), k), -2.0, u.dtype)  # greatest similarity of a candidate to one chosen
        for j in range(k):
            take = np.flatnonzero((count < EDGES) & (between[:, j] < sims[:, j]))
            if not len(take):
                continue
            out[own[take], count[take]] = cand[take, j]
            count[take] += 1
            if j + 1 < k:
                s = np.einsum("qkd,qd->qk", u[cand[take, j + 1 :]], u[cand[take, j]])
                between[take, j + 1 :] = np.maximum(between[take, j + 1 :], s)
    return out


def hung(hosts: np.ndarray, below: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
    """Edges (three of each of n vertices) by which every vertex of below is reached from its host: binary trees, the
    most similar first. A vertex is in one tree, and a host of one, so three edges are enough."""
    out = np.full((n, 3), -1, np.int64)
    order = np.lexsort((below, -sims, hosts))
    hosts, below = hosts[order], below[order]
    begin = np.searchsorted(hosts, hosts)
    place = np.arange(len(hosts)) - begin + 1
    root = place == 1
    out[hosts[root], 0] = below[root]
    at = np.flatnonzero(~root)
    out[below[begin[at] + place[at] // 2 - 1], 1 + place[at] % 2] = below[at]
    return out


def reached(neighbours: np.ndarray) -> np.ndarray:
    """Marks of the vertices that edges lead to from the first one."""
    seen = np.zeros(len(neighbours), bool)
    new = np.array([0])
    while len(new):
        seen[new] = True
        near = neighbours[new]
        near = np.unique(near[near >= 0])
        new = near[~seen[near]]
    return seen


def connected(u: np.ndarray, forth: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """neighbours (by place) with edges that lead to each vertex from its nearest one, and to all from the first."""
    n = len(u)
    nearest = forth[:, 0]
    lost = np.flatnonzero((nearest >= 0) & ~(neighbours[nearest] == np.arange(n)[:, None]).any(axis=1))
    neighbours = np.concatenate([neighbours, hung(nearest[lost], lost, np.einsum("ed,ed->e", u[lost], u[nearest[lost]]), n)], axis=1)
    seen = reached(neighbours)
    far, near = np.flatnonzero(~seen), np.flatnonzero(seen)
    hosts, sims = np.zeros(len(far), np.int64), np.zeros(len(far))
    for first in range(0, len(far), TOGETHER):
        s = u[far[first : first + TOGETHER]] @ u[near].T
        hosts[first : first + TOGETHER], sims[first : first + TOGETHER] = near[s.argmax(axis=1)], s.max(axis=1)
    return np.concatenate([neighbours, hung(hosts, far, sims, n)], axis=1)


def build(keys: np.ndarray, u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vertices, neighbours of these by place, -1 where there are fewer) of each layer, the lowest first."""
    top = layers_of(keys)
    out = []
    for layer in range(int(top.max()) + 1):
        own = np.flatnonzero(top >= layer)
        forth = chosen(u[own])
        a, b = np.repeat(np.arange(len(own)), EDGES), forth.ravel()
        a, b = a[b >= 0], b[b >= 0].astype(np.int64)
        pairs = np.unique(np.concatenate([a * len(own) + b, b * len(own) + a]))
        a, b = pairs // len(own), pairs % len(own)
        # of many edges back, the nearest stay; a vertex' own are always kept
        mine = (forth[a] == b[:, None]).any(axis=1)
        s = np.einsum("ed,ed->e", u[own[a]], u[own[b]])
        order = np.lexsort((-s, ~mine, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        keep = rank < 2 * EDGES
        neighbours = np.full((len(own), 2 * EDGES), -1, np.int64)
        neighbours[a[keep], rank[keep]] = b[keep]
        neighbours = connected(u[own], forth, neighbours)
        out.append((own.astype(np.int32), np.where(neighbours >= 0, own[neighbours], -1).astype(np.int32)))
    return out


def descend(graph, u: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The vertex of the lowest layer to begin at, for each query."""
    here = np.full(len(q), graph[-1][0][0], np.int64)
    sims = q @ u[here[0]]
    for own, neighbours in reversed(graph[1:]):
        row = np.full(len(u), -1, np.int64)
        row[own] = np.arange(len(own))
        move = np.arange(len(q))
        while len(move):
            near = neighbours[row[here[move]]].astype(np.int64)
            s = np.where(near >= 0, np.einsum("qkd,qd->qk", u[near], q[move]), -2)
            best = s.argmax(axis=1)
            at = np.arange(len(move))
            better = s[at, best] > sims[move]
            here[move[better]], sims[move[better]] = near[at, best][better], s[at, best][better]
            move = move[better]
    return here


def search(graph, u: np.ndarray, q: np.ndarray, beam: int, least: float) -> np.ndarray:
    """Marks, by query and vertex, of the vertices found whose similarity is at least least."""
    n, m = len(u), len(q)
    found = np.zeros((m, n), bool)
    neighbours = graph[0][1]
    beam = min(beam, n)
    wide = max(1, beam // STEP)
    for first in range(0, m, TOGETHER):
        own = q[first : first + TOGETHER]
        k = len(own)
        seen = np.zeros((k, n), bool)
        ids = np.full((k, beam), -1, np.int64)
        sims = np.full((k, beam), -2.0)
        open_ = np.zeros((k, beam), bool)
        ids[:, 0] = descend(graph, u, own)
        sims[:, 0] = np.einsum("qd,qd->q", u[ids[:, 0]], own)
        open_[:, 0] = True
        seen[np.arange(k), ids[:, 0]] = True
        hits = [(np.arange(k)[sims[:, 0] >= least], ids[:, 0][sims[:, 0] >= least])]
        live = np.arange(k)
        while len(live):
            best = np.argpartition(-np.where(open_[live], sims[live], -3), wide - 1, axis=1)[:, :wide]
            at = np.where(open_[live[:, None], best], ids[live[:, None], best], -1)
            open_[live[:, None], best] = False
            near = np.where(at[:, :, None] >= 0, neighbours[at], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            new = (near >= 0) & ~seen[live[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            x, y = np.nonzero(new)
            v = near[x, y]
            seen[live[x], v] = True
            s = np.full(near.shape, -2.0)
            s[x, y] = np.einsum("ed,ed->e", u[v], own[live[x]])
            hit = s[x, y] >= least
            hits.append((live[x[hit]], v[hit]))
            all_s = np.concatenate([sims[live], s], axis=1)
            all_i = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
            all_o = np.concatenate([open_[live], new], axis=1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[live], ids[live], open_[live] = (np.take_along_axis(a, keep, 1) for a in (all_s, all_i, all_o))
            live = live[open_[live].any(axis=1)]
        # from what is near enough to all that is
        x, v = (np.concatenate(z) for z in zip(*hits))
        while len(x):
            found[first + x, v] = True
            near = neighbours[v].astype(np.int64)
            x2 = np.repeat(x, near.shape[1])
            v2 = near.ravel()
            ok = v2 >= 0
            code = np.unique(x2[ok] * n + v2[ok])
            x2, v2 = code // n, code % n
            fresh = ~seen[x2, v2]
            x2, v2 = x2[fresh], v2[fresh]
            seen[x2, v2] = True
            s = np.concatenate([np.einsum("ed,ed->e", u[v2[a : a + 65536]], own[x2[a : a + 65536]]) for a in range(0, len(x2), 65536)]) if len(x2) else np.zeros(0)
            x, v = x2[s >= least], v2[s >= least]
    return found


def _index(t: pa.Table) -> pa.Table:
    """The vertices of a shard and their graph."""
    keys = np.frombuffer(b"".join(t["key"].to_pylist()), "V16")
    dim = t["dim"][0].as_py()
    order = np.array(sorted(range(len(keys)), key=keys.tolist().__getitem__))
    keys = keys[order]
    vectors = np.frombuffer(b"".join(t["vector"].to_pylist()), np.float64).reshape(-1, dim)[order]
    counts = t["copies"].to_numpy()[order].astype(np.int64)
    graph = build(keys, unit(vectors))
    head = np.array([len(graph), *(len(own) for own, _ in graph)], np.int32)
    blob = head.tobytes() + b"".join(own.tobytes() + near.tobytes() for own, near in graph)
    row = [t["label"][0].as_py(), dim, t["shard"][0].as_py(), keys.tobytes(), counts.tobytes(), vectors.tobytes(), blob]
    types = (pa.int64(), pa.int32(), pa.int32(), *(pa.binary(),) * 4)
    return pa.table([pa.array([x], kind) for x, kind in zip(row, types)], names=[x.split()[0] for x in _SHARD.split(", ")])


def _graph(blob: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    head = np.frombuffer(blob, np.int32)
    out, at = [], 1 + head[0]
    for n in head[1 : 1 + head[0]].tolist():
        out.append((head[at : at + n], head[at + n : at + n + n * (2 * EDGES + 6)].reshape(n, 2 * EDGES + 6)))
        at += n + n * (2 * EDGES + 6)
    return out


def links_between(queries: np.ndarray, vectors: np.ndarray, graph, least: float, beam: int = BEAM) -> tuple[np.ndarray, int]:
    """(marks by query and vertex of pairs with at least that cosine in double precision, the beam it took)."""
    q, u = unit(queries), unit(vectors)
    audit = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDITED)).astype(np.int64))
    truth = q[audit] @ u.T >= least
    while True:
        if beam > len(u) // WIDEST:  # the whole shard
            beam = len(u)
            found = np.concatenate([q[first : first + TOGETHER] @ u.T >= least - 1e-9 for first in range(0, len(q), TOGETHER)])
            break
        found = search(graph, u, q, beam, least - 1e-9)
        if (found[audit] & truth).sum() >= RECALL * truth.sum():
            break
        beam *= 2
    x, v = np.nonzero(found)
    dots = np.einsum("ed,ed->e", queries[x], vectors[v])
    sizes = np.sqrt((queries * queries).sum(axis=1))[x] * np.sqrt((vectors * vectors).sum(axis=1))[v]
    bad = dots / sizes < least
    found[x[bad], v[bad]] = False
    return found, beam


_LINKS = "key binary, links long, root binary"


def _query(least: float):
    """A pair of shards, or a shard with itself, to the links and the class of each vertex that has some."""

    def run(t: pa.Table) -> pa.Table:
        row = {n: t[n][0].as_py() for n in t.column_names}
        dim = row["dim"]
        keys = np.frombuffer(row["keys"], "V16")
        counts, vectors, graph = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, dim), _graph(row["graph"])
        if row["q_shard"] == row["shard"]:
            marks, _ = links_between(vectors, vectors, graph, least)
            marks |= marks.T
            np.fill_diagonal(marks, False)
            links = marks @ counts
            x, v = np.nonzero(np.triu(marks))
        else:
            own = np.frombuffer(row["q_keys"], "V16")
            marks, _ = links_between(np.frombuffer(row["q_vectors"], np.float64).reshape(-1, dim), vectors, graph, least)
            links = np.concatenate([marks @ counts, marks.T @ np.frombuffer(row["q_counts"], np.int64)])
            x, v = np.nonzero(marks)
            v = v + len(own)
            keys = np.concatenate([own, keys])
        root = np.arange(len(keys))
        while True:  # the smallest neighbour's class, until nothing changes
            before = root.copy()
            low = np.minimum(root[x], root[v])
            np.minimum.at(root, x, low)
            np.minimum.at(root, v, low)
            root = root[root]
            if (root == before).all():
                break
        have = np.flatnonzero(links)
        names = pa.array([k.tobytes() for k in keys[have]], pa.binary())
        return pa.table([names, pa.array(links[have].astype(np.int64)), pa.array([k.tobytes() for k in keys[root[have]]], pa.binary())], names=["key", "links", "root"])

    return run


def near_duplicates(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of rows(vec_id, embedding, label)."""
    common.prepare(common.spark_of(rows))
    vertices = common.stored(_vertices(rows), "vertices")
    valid = vertices.where("key IS NOT NULL")
    distinct = valid.groupBy("label", "dim", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    families = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    dealt = distinct.join(families, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    index = common.stored(dealt.drop("shards").groupBy("label", "dim", "shard").applyInArrow(common.lean(_index), _SHARD), "index")
    queries = index.select("label", "dim", *(F.col(c).alias(f"q_{c}") for c in ("shard", "keys", "counts", "vectors")))
    pairs = queries.join(index, ["label", "dim"]).where("q_shard <= shard")
    # few bytes but much work: as many partitions as pairs of shards
    parts = families.agg(F.sum(F.expr("bigint(shards) * (shards + 1) div 2"))).first()[0] or 1
    pairs = pairs.repartition(max(1, min(parts, MOST_PARTS)), "label", "dim", "q_shard", "shard")
    found = common.stored(pairs.groupBy("label", "dim", "q_shard", "shard").applyInArrow(common.lean(_query(least)), _LINKS), "links")
    parts = common.components(found.select("key", "root"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    copies = distinct.select("key", "copies")
    # copies of a vector are at its vertex; a class is known by its vertex' key
    vertex = copies.join(links, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    vertex = vertex.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("class"))
    out = vertices.select("vec_id", "key").join(common.stored(vertex, "vertex"), "key", "left")
    least_id = out.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("least"))
    out = out.join(least_id, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
