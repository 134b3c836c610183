"""Numeric and column functions, options, pairs, cover, files."""

import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planeprint import sinks
from planeprint.functions import native, numeric
from planeprint.operators import cover, hashing, similar
from planeprint.options import CommandOptions, HashOptions, parse_extensions


def test_basis_is_orthonormal():
    for n in (4, 8, 32):
        d = numeric.dct_basis(n)
        assert np.allclose(d @ d.T, np.eye(n)) and np.allclose(d[0], 1 / np.sqrt(n))
    assert np.allclose(numeric.dct_basis(8)[1], np.sqrt(2 / 8) * np.cos((2 * np.arange(8) + 1) * np.pi / 16))


def test_resize():
    rows = numeric.resize_matrix(8, 16)
    assert np.allclose(rows.sum(axis=1), 1) and ((rows != 0).sum(axis=1) <= 4).all()
    gradient = np.tile(np.arange(20) * 255 // 20, (10, 1)).astype(np.uint8)
    assert numeric.resize(gradient, 8).shape == (8, 8)
    one = numeric.resize(np.tile(np.arange(10) * 25, (10, 1)), 1)
    assert 0 <= one[0, 0] <= 255
    y, x = np.mgrid[:64, :64]
    board = np.where((x // 8 + y // 8) % 2 == 0, 255, 0)
    assert numeric.resize(board, 32).min() < 128 < numeric.resize(board, 32).max()


@pytest.mark.parametrize("transform", ["reference", "forward"])
def test_fused_transform_is_the_full_one(transform):
    plane = np.random.default_rng(1).integers(0, 256, (37, 23)).astype(np.uint8)
    d = numeric.dct_basis(32)
    small = numeric.resize(plane, 32)
    full = (d.T @ small @ d if transform == "reference" else d @ small @ d.T)[:8, :8].ravel()
    full[0] = 0
    assert np.allclose(numeric.coefficients(plane[None], 8, 4, transform)[0], full, atol=1e-6)


def test_median_words():
    def bits(block):
        c = np.array(block, float).reshape(1, -1)
        c[:, 0] = 0
        return int(numeric.words(c)[0, 0]) & (2**64 - 1)

    i, j = np.mgrid[:8, :8]
    assert bits(np.zeros((8, 8))) == 0
    assert 20 < bin(bits(np.where(np.arange(64) < 32, 100, -100))).count("1") < 44
    assert 10 < bin(bits(np.where((i + j) % 2 == 0, 100, -100))).count("1") < 54
    high = np.full((8, 8), 50.0)
    high[0, 0] = 1e6
    assert bits(high) != 2**64 - 1


def test_network_median():
    c = np.random.default_rng(2).normal(size=(50, 64))
    assert np.allclose(numeric.medians(c, "reference"), np.median(c, axis=1))
    assert numeric.medians(c[:, :49], "reference").shape == (50,)


def test_bit_positions():
    p = numeric.bit_positions(32, 8)
    assert p[0] == [98, 101, 29, 1, 36, 41, 126, 126] and p[31] == [64, 74, 31, 66, 42, 62, 19, 127]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_keys_and_hex(spark):
    rows = [(1, signed(0xAAAAAAAAAAAAAAAA), signed(0x5555555555555555)), (2, -1, signed(0xAAAAAAAAAAAAAAAA))]
    df = spark.createDataFrame(rows, "id long, w0 long, w1 long")
    c = F.col
    got = df.select(native.lsh_key(c("w0"), c("w1"), list(range(8))), native.lsh_key(c("w0"), c("w1"), list(range(60, 68))), native.hash_hex(c("w0"), c("w1"), 64), native.hash_hex(c("w0"), c("w1"), 49, "reference")).collect()
    assert got[0][0] == 0xAA and got[1][1] == 0xAF and got[1][2] == "f" * 16 and len(got[0][3]) == 13


def test_size_text(spark):
    cases = {0: "0.00 B", 1023: "1023.00 B", 1024: "1.00 KB", 1536: "1.50 KB", 10 << 20: "10.00 MB", 5 << 30: "5.00 GB", 2 << 40: "2.00 TB"}
    rows = spark.createDataFrame([(k,) for k in cases], "n long").select("n", native.size_text(F.col("n"))).collect()
    assert {r[0]: r[1] for r in rows} == cases == {k: native.size_label(k) for k in cases}


def test_extensions(spark):
    assert parse_extensions("jpg,jpeg") == ["jpg", "jpeg"] and parse_extensions("") == []
    assert parse_extensions("  .PNG  , jpg ,,png,") == ["png", "jpg"]
    names = ["a/b.JPG", "a/.hidden", "x.tar.gz", "a.b/c"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(native.extension(F.col("p"))).collect()
    assert [r[0] for r in got] == ["jpg", "", "gz", ""]


def test_options(tmp_path):
    d = str(tmp_path)
    assert CommandOptions(d).extension_list == ["jpg", "jpeg"]
    for bad in ({"hash_size": 4}, {"hash_size": 12}, {"threads": 0}, {"log_level": 5}, {"batch_size": 0}, {"command": "similar", "threshold": 65}, {"command": "similar", "auto_delete": True, "interactive": True}):
        with pytest.raises(ValueError):
            CommandOptions(d, **bad)
    CommandOptions(d, threshold=65)
    with pytest.raises(ValueError):
        CommandOptions(d + "/none")
    with pytest.raises(ValueError):
        HashOptions(freq_factor=9)


def brute(hashes, tau):
    out = set()
    for (i, a, b), (j, c, d) in itertools.combinations(hashes, 2):
        dist = bin((a ^ c) & (2**64 - 1)).count("1") + bin((b ^ d) & (2**64 - 1)).count("1")
        if dist < tau:
            out.add((min(i, j), max(i, j), dist))
    return out


def test_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(60):
        x = rng.choice(base)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        rows.append((i, signed(x), 0))
    df = spark.createDataFrame(rows, "id long, w0 long, w1 long")
    for tau in (0, 1, 5, 12):
        exact = {tuple(r) for r in similar.exact_pairs(df, tau).collect()}
        assert exact == brute(rows, tau)
    exact = {tuple(r) for r in similar.exact_pairs(df, 30).collect()}
    assert exact == brute(rows, 30)
    lsh = {tuple(r) for r in similar.lsh_pairs(df, 5).collect()}
    ref = {tuple(r) for r in similar.lsh_reference_pairs(df, 5).collect()}
    assert ref <= lsh <= brute(rows, 5)


def test_pairs_of_blocks_wide_hashes_and_repeated_ids(spark, monkeypatch):
    """As SQL has it, i < j: two rows of one id are no pair."""
    rng = random.Random(5)
    base = [(rng.getrandbits(64), rng.getrandbits(57)) for _ in range(4)]
    rows = [(5, 0, 0), (5, 1, 0)]
    for i in range(150):
        a, b = rng.choice(base)
        for _ in range(rng.randrange(7)):
            a, b = (a ^ 1 << rng.randrange(64), b) if rng.random() < 0.5 else (a, b ^ 1 << rng.randrange(57))
        rows.append((i, signed(a), b))
    df = spark.createDataFrame([*rows, (None, 0, 0), (999, None, 0)], "id long, w0 long, w1 long")
    monkeypatch.setattr(similar, "BLOCK", 20)
    for tau in (1, 5, 9):
        want = sorted(x for x in ((*sorted((p[0], q[0])), ((p[1] ^ q[1]) & (2**64 - 1)).bit_count(), (p[2] ^ q[2]).bit_count()) for p, q in itertools.combinations(rows, 2)) if x[0] < x[1] and x[2] + x[3] < tau)
        assert sorted(tuple(r) for r in similar.exact_pairs(df, tau, 121).collect()) == [(i, j, c + d) for i, j, c, d in want]


def test_pairs_of_many_hashes(spark):
    """All 450 million pairs of 30000 hashes are compared: rows of a join took minutes for that."""
    w = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 30_000)
    df = spark.createDataFrame(list(zip(range(30_000), w.tolist())), "id long, w0 long").withColumn("w1", F.lit(0).cast("long"))
    began = time.time()
    got = similar.exact_pairs(df, 18).count()
    assert time.time() - began < 40
    u = w.view(np.uint64)
    assert got == sum(int((np.bitwise_count(u[i] ^ u[i + 1 :]) < 18).sum()) for i in range(len(u)))


def test_degrees_of_many_embeddings(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from planeprint import plans

    e = np.random.default_rng(16).normal(size=(25_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(25_000), "embedding": list(e)}), tmp_path / "embeddings.parquet")
    began = time.time()
    got = {r.id: r.degree for r in plans.edge_degree(spark, str(tmp_path)).collect()}
    assert time.time() - began < 40
    c = e.astype(float)
    c[:, 0] = 0
    u, want = numeric.words(c)[:, 0].copy().view(np.uint64), np.zeros(25_000, int)
    for i in range(len(u)):
        want[i] = (np.bitwise_count(u[i] ^ u) < plans.TAU).sum() - 1
    assert got == {i: int(n) for i, n in enumerate(want) if n}


def test_degrees_are_counted_in_tiles(spark, monkeypatch):
    """As the degrees of the pairs, with blocks, parts, nulls and repeated ids; of 30000 copies no pair is a row."""
    from planeprint import plans

    rng = random.Random(6)
    rows = [(5, 0, 0), (5, 1, 0), (7, 1, 0), *((i, signed(rng.getrandbits(4) << 60 | rng.getrandbits(6)), 0) for i in range(120))]
    df = spark.createDataFrame([*rows, (None, 0, 0), (999, None, 0)], "id long, w0 long, w1 long")
    with monkeypatch.context() as m:
        m.setattr(similar, "BLOCK", 20)
        for tau in (0, 1, 5, 9):
            want = {r.id: r.degree for r in cover.degrees(similar.exact_pairs(df, tau)).collect()}
            assert {r.id: r.degree for r in similar.exact_degrees(df, tau).collect()} == want and bool(want) == bool(tau)
    copies = spark.range(30_000).select("id", F.lit(7).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1"))
    began = time.time()
    assert [tuple(r) for r in similar.exact_degrees(copies, 20).groupBy("degree").count().collect()] == [(29_999, 30_000)]
    assert time.time() - began < 40
    plan = plans.edge_degree(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "explode(array(i" not in plan


def test_pairs_of_hashes_that_share_their_low_bits(spark):
    """As hashes of documents do; two of five chunks of neighbouring bits told none of these apart."""
    w = np.random.default_rng(14).integers(0, 2**39, 30_000) << 25
    w[15_000:] = w[:15_000] ^ (1 << np.random.default_rng(15).integers(0, 63, 15_000))
    df = spark.createDataFrame(list(zip(range(30_000), w.tolist())), "id long, w0 long").withColumn("w1", F.lit(0).cast("long"))
    began = time.time()
    got = similar.exact_pairs(df, 5).count()
    assert time.time() - began < 40
    u = w.view(np.uint64)
    assert got == sum(int((np.bitwise_count(u[i] ^ u[i + 1 :]) < 5).sum()) for i in range(len(u))) >= 15_000


def expanded(members, links):
    """Pairs of ids from members {id: representatives} and links {(representatives): distance}."""
    out = set()
    for (p, a), (q, b) in itertools.combinations([(p, a) for p, own in members.items() for a in own], 2):
        if p != q and (a == b or (min(a, b), max(a, b)) in links):
            out.add((min(p, q), max(p, q)))
    return out


def test_pairs_of_classes_say_all_pairs(spark):
    """Classes and their pairs against all pairs, also with nulls, repeated rows and ids with several hashes."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = [(3, signed(base[0]), 0), (3, signed(base[1]), 0), (90, 0, 0), (90, 0, 0)]
    rows += [(i, signed(rng.choice(base) ^ (1 << rng.randrange(64) if i % 3 else 0)), 0) for i in range(70)]
    df = spark.createDataFrame([*rows, (None, 0, 0), (999, None, 0)], "id long, w0 long, w1 long")
    got = similar.classes(df)
    members = {}
    for r in got.collect():
        members.setdefault(r.id, set()).add(r.rep)
    assert members[3] == {3} and all(own == {k} or 3 not in own for k, own in members.items())
    links = {(r.i, r.j): r.dist for r in similar.class_pairs(got, 5).collect()}
    assert expanded(members, links) == {(i, j) for i, j, _ in brute(rows, 5) if i < j}


def test_document_pairs_of_copies(spark, tmp_path):
    """3000 copies were 4498500 rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from planeprint import plans

    texts = ["lorem ipsum " * 40] * 3000 + ["lorem ipsum " * 39 + "lorem ipsum!", None, "", "x"]
    pq.write_table(pa.table({"doc_id": np.arange(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    got = plans.document_similar_pairs(spark, str(tmp_path)).collect()
    hashes = [(int(r.path), r.w0, 0) for r in plans.document_hashes(spark, str(tmp_path)).where("w0 IS NOT NULL AND path >= '000000002999'").collect()]
    assert {(r.i, r.j) for r in got if r.copy and r.j < 3000} == {(0, j) for j in range(1, 3000)} and len(got) < 3010
    members = {k: {k} for k, _, _ in hashes} | {r.j: {r.i} for r in got if r.copy} | {0: {0}}
    links = {(r.i, r.j): r.dist for r in got if not r.copy}
    near = {x for x in expanded({k: v for k, v in members.items() if k >= 2999}, links)}
    assert near == {(i, j) for i, j, _ in brute(hashes, 5)}


def test_report_of_a_large_class(spark):
    """700 copies, any two of them an edge: each round of the cover took one."""
    df = spark.range(700).select("id", F.col("id").cast("string").alias("path"), F.lit(7).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1"))
    began = time.time()
    got = {r.id: (r.similar_to, r.dist) for r in cover.find_similar(df).collect()}
    assert time.time() - began < 30
    assert got == {k: ("0", 0) for k in range(1, 700)}


def test_capped_enumeration(spark):
    df = spark.createDataFrame([(i, 0, 0) for i in range(10)], "id long, w0 long, w1 long")
    assert similar.lsh_reference_pairs(df, 5, 1, 8, cap=5).count() <= 5
    got = {(r.i, r.j) for r in similar.lsh_reference_pairs(df, 5, 1, 8).collect()}
    assert got == {(i, j) for i in range(10) for j in range(10) if i < j <= min(2 * i + 1, 9)}


def test_reference_pairs_of_large_buckets(spark, monkeypatch):
    """Without a cap the 100 million pairs of the buckets of 8000 hashes are compared, not made as rows of a join."""
    w = np.random.default_rng(8).integers(-(2**63), 2**63 - 1, 8000)
    df = spark.createDataFrame(list(zip(range(8000), w.tolist())), "id long, w0 long").withColumn("w1", F.lit(0).cast("long"))
    monkeypatch.setattr(similar, "BLOCK", 512)
    began = time.time()
    got = sorted(tuple(r) for r in similar.lsh_reference_pairs(df, 18, cap=1 << 40).collect())
    assert time.time() - began < 40
    u, want = w.view(np.uint64), set()
    for positions in numeric.bit_positions(32, 8):
        key = sum(((u >> np.uint64(p)) & np.uint64(1)) << np.uint64(b) for b, p in enumerate(positions) if p < 64)
        for k in np.unique(key):
            own = np.flatnonzero(key == k)
            for r in range(len(own)):
                c = own[r + 1 : 2 * r + 2]
                d = np.bitwise_count(u[own[r]] ^ u[c])
                want |= {(int(own[r]), int(j), int(x)) for j, x in zip(c[d < 18], d[d < 18])}
    assert got == sorted(want) and got


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda e: e[0] < e[1]), max_size=30))
def test_greedy_covers(edges):
    out = set(cover.greedy(sorted(edges)))
    assert all(i in out or j in out for i, j in edges)


def test_greedy_takes_the_largest_first():
    """Against the definition: again and again the node with most uncovered edges, of equal ones the largest id."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        edges = {tuple(sorted(rng.choice(12, 2, replace=False).tolist())) for _ in range(rng.integers(1, 25))}
        left, want = set(edges), set()
        while left:
            n = max(range(12), key=lambda k: (sum(k in e for e in left), k))
            want.add(n)
            left = {e for e in left if n not in e}
        assert set(cover.greedy(edges)) == want


def test_greedy_order():
    assert cover.greedy([(0, 1)]) == [1]
    assert cover.greedy([(0, 1), (0, 2), (1, 2)]) == [2, 1]
    assert cover.greedy([(0, 1), (1, 2)]) == [1] and cover.greedy([(0, 1), (0, 2), (0, 3)]) == [0]
    assert cover.greedy([(0, 1), (1, 2), (2, 3)]) == [2, 1]


def test_reference_cap_grows_with_the_hashes(spark):
    """200 000 hashes, 300 of them equal: their bucket has 44850 pairs, of which the original enumerates 20000."""
    w0 = F.when(F.col("id") < 300, F.lit(0)).otherwise(F.xxhash64("id"))
    df = spark.range(200_000).select("id", w0.cast("long").alias("w0"), F.lit(0).cast("long").alias("w1"))
    got = {(r.i, r.j) for r in similar.find_pairs(df, 1, "lsh_reference", tables=1, bits_per_table=60).collect()}
    want = set()
    for p in range(0, 20_000 * (44850 // 20_000), 44850 // 20_000):
        i = (math.isqrt(8 * p + 1) - 1) // 2
        j = p - i * (i + 1) // 2 + i + 1
        if j < 300:
            want.add((i, j))
    assert got == want


def test_components_and_nearest(spark):
    e = spark.createDataFrame([(0, 1, 3), (1, 2, 1), (5, 6, 2), (4, 6, 2)], "i long, j long, dist int")
    assert {tuple(r) for r in cover.components(e).collect()} == {(0, 0), (1, 0), (2, 0), (4, 4), (5, 4), (6, 4)}
    assert {tuple(r) for r in cover.nearest(e).collect()} == {(0, 1, 3), (1, 2, 1), (2, 1, 1), (4, 6, 2), (5, 6, 2), (6, 4, 2)}
    for most in (cover.TASK_EDGES, 0):
        assert {r.id for r in cover.greedy_cover(e, most).collect()} == {1, 6}
    assert cover.components(e.where("false")).count() == 0


def test_nearest_reads_its_edges_once(spark):
    e = spark.range(100).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1).alias("dist"))
    plan = cover.nearest(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1


def test_components_by_either_end(spark, monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(cover, "HELD", 50)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 400, (350, 2))]
    e = spark.createDataFrame([*pairs, (None, 3), (4, None)], "i long, j long").repartition(3)
    root = {k: k for p in pairs if p[0] != p[1] for k in p}
    for _ in range(400):
        for i, j in pairs:
            if i != j:
                root[i] = root[j] = min(root[i], root[j])
    for most in (cover.TASK_EDGES, 0):
        assert sorted(tuple(r) for r in cover.components(e, most).collect()) == sorted(root.items())


def test_cover_of_a_dense_graph(spark):
    """300000 edges among 3000 nodes: each round found a few nodes above their neighbours, so there were hundreds."""
    rng = np.random.default_rng(13)
    pairs = np.unique(np.sort(rng.integers(0, 3000, (320_000, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    e = spark.createDataFrame(pairs.tolist(), "i long, j long")
    began = time.time()
    got = {r.id for r in cover.greedy_cover(e).collect()}
    assert len(pairs) > 200_000 and time.time() - began < 30
    near = np.zeros((3000, 3000), bool)
    near[pairs[:, 0], pairs[:, 1]] = near[pairs[:, 1], pairs[:, 0]] = True
    want, degree = set(), near.sum(axis=1)
    while degree.max():
        n = 2999 - int(degree[::-1].argmax())
        want.add(n)
        degree[near[n]] -= 1
        near[n] = near[:, n] = False
        degree[n] = 0
    assert got == want


def test_cover_of_more_edges_than_memory_was_set_aside_for(spark):
    """All 16242150 pairs of 5700 nodes: beyond 16 million edges the cover went in rounds, each of which took one node here."""
    ids = spark.range(5700)
    e = ids.select(F.col("id").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("i")).where("i >= 0 AND i < j")
    began = time.time()
    got = sorted(r.id for r in cover.greedy_cover(e).collect())
    assert got == list(range(1, 5700)) and time.time() - began < 120


def test_cover_of_packs(monkeypatch):
    """Edges in many packs, in both directions and more than once, are those of one."""
    monkeypatch.setattr(cover, "HELD", 7)
    rng = np.random.default_rng(14)
    for n in (5, 40, 300):
        edges = rng.integers(0, n, (3 * n, 2)) * 1_000_003 - 7
        i, j = edges.T
        parts = [(i[k::5], j[k::5]) for k in range(5)] + [(j[::3], i[::3])]
        want = cover.greedy({(a, b) for a, b in np.sort(edges, axis=1).tolist() if a != b})
        assert cover._greedy(parts).tolist() == cover._greedy([(i, j)]).tolist() == want


def test_packs_keep_their_edges():
    rng = np.random.default_rng(15)
    for n, m in ((4, 1), (30, 60), (200_000, 300_000)):
        i, j, d = rng.integers(0, n, m) * 3, rng.integers(0, n, m) * 3 + 1, rng.integers(0, 5, m).astype(np.int32)
        ids, best, count, near, dist = numeric.from_bytes(numeric.to_bytes(numeric.packed(i, j, d)))
        ends = np.stack([np.repeat(ids, count), ids[near]])
        assert np.array_equal(*(z[:, np.lexsort(z)] for z in (ends, np.stack([np.concatenate([i, j]), np.concatenate([j, i])]))))
        want: dict[int, tuple[int, int]] = {}
        for a, b, c in zip(i.tolist(), j.tolist(), d.tolist()):
            want[a], want[b] = min(want.get(a, (9, 0)), (c, b)), min(want.get(b, (9, 0)), (c, a))
        assert {k: (x, y) for k, x, y in zip(ids.tolist(), dist.tolist(), best.tolist())} == want


def test_cover_of_classes(spark):
    """A cover of classes is that of all their pairs, in one task and in rounds."""
    rng = random.Random(9)
    for _ in range(60):
        ids = rng.sample(range(100), 14)
        classes = [sorted(ids[a:b]) for a, b in zip((0, 1, 3, 4, 9), (1, 3, 4, 9, 14))]
        links = [(p, q) for p, q in itertools.combinations(classes, 2) if rng.random() < 0.5]
        pairs = [x for own in classes for x in itertools.combinations(own, 2)] + [x for p, q in links for x in itertools.product(p, q)]
        rep, member = zip(*((own[0], k) for own in classes for k in own))
        ends = np.array([(p[0], q[0]) for p, q in links], dtype=np.int64).reshape(-1, 2)
        assert sorted(cover._greedy([(ends[:, 0], ends[:, 1])], rep, member).tolist()) == sorted(cover.greedy(pairs))
    e = spark.createDataFrame([(p[0], q[0]) for p, q in links], "i long, j long")
    members = spark.createDataFrame(list(zip(member, rep)), "id long, rep long")
    for most in (None, 1, 0):
        assert sorted(r.id for r in cover.greedy_cover(e, most, members).collect()) == sorted(cover.greedy(pairs))


@pytest.mark.parametrize("most", [None, 0])
def test_report_of_classes(spark, monkeypatch, most):
    """find_similar() makes no pairs of equal hashes, and gives what its pairs would."""
    rng = random.Random(10)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = [(3, "3", signed(base[0]), 0), (3, "3", signed(base[1]), 0), *((i, str(i), signed(rng.choice(base) ^ (1 << rng.randrange(64) if i % 2 else 0)), 0) for i in range(10, 60))]
    df = spark.createDataFrame(rows, "id long, path string, w0 long, w1 long")
    edges = similar.exact_pairs(df, 5)
    near = {r.id: (str(r.neighbour), r.dist) for r in cover.nearest(edges).collect()}
    want = {k: near[k] for k in cover.greedy({(r.i, r.j) for r in edges.collect()})}
    if most is not None:
        monkeypatch.setattr(cover, "COVER_EDGES", most)
    monkeypatch.setattr(similar, "find_pairs", None)
    assert {r.id: (r.similar_to, r.dist) for r in cover.find_similar(df).collect()} == want


def test_relational_hash(spark):
    rng = np.random.default_rng(5)
    planes = rng.integers(0, 256, (3, 32, 32)).astype(np.uint8)
    cells = spark.createDataFrame([(k, y, x, float(planes[k, y, x])) for k in range(3) for y in range(32) for x in range(32)], "id long, y int, x int, v double")
    coef = hashing.coefficients_relational(cells, 32, 8)
    got = {r.id: r.w0 for r in hashing.words_relational(coef).collect()}
    rows = spark.createDataFrame([(k, bytearray(planes[k].tobytes()), 32, 32) for k in range(3)] + [(9, None, None, None)], "id long, luma binary, width int, height int")
    # a plane of the square's own side is still resampled by hash_planes, so compare its coefficients directly
    d = numeric.low_rows(32, 8, "reference")
    want = np.round(d @ planes.astype(float) @ d.T, 6).reshape(3, 64)
    want[:, 0] = 0
    assert [got[k] for k in range(3)] == numeric.words(want)[:, 0].tolist()
    hashed = {r.id: r for r in hashing.compute_hashes(rows).collect()}
    assert hashed[9].w0 is None and hashed[9].reason and hashed[0].reason is None


def test_document_coefficients_of_whole_texts(spark, tmp_path):
    from planeprint import plans

    rng = np.random.default_rng(9)
    long = "".join(map(chr, rng.integers(32, 1000, 5000)))
    texts = {0: long, 1: long[:700] + "X" * 2000, 2: long[:700] + "Y" * 2000, 3: "", 4: None, 5: "short é", 10**13: "x" * 1024 + "tail"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in plans.document_coefficients(spark, str(tmp_path)).collect():
        got.setdefault(r.id, {})[r.t] = r.c
    assert got.keys() == texts.keys() and all(sorted(x) == list(range(64)) for x in got.values())
    d = numeric.dct_basis(32)
    for i, text in texts.items():
        raw = (text or "").encode()
        if not raw:
            assert set(got[i].values()) == {None}
            continue
        width = min(64, len(raw))
        plane = np.frombuffer(raw + bytes(-len(raw) % width), np.uint8).reshape(-1, width)
        full = (d.T @ numeric.resize(plane, 32) @ d)[:8, :8].ravel()
        full[0] = 0
        own = [got[i][t] for t in range(64)]
        assert np.allclose(own, full, atol=1e-3) and np.allclose(own, numeric.coefficients(plane[None], 8, 4)[0], atol=6e-4)
    assert got[1] != got[2]


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"p{i:03d}", i if i % 7 else None) for i in range(50)], "path string, w0 long")
    rows = hashing.with_dense_ids(df).orderBy("path").collect()
    assert [r.id for r in rows] == list(range(len(rows)))


def write_jpeg(spark, path, values, size=24):
    jvm = spark._jvm
    im = jvm.java.awt.image.BufferedImage(size, size, 10)  # gray
    raster = im.getRaster()
    for y in range(size):
        for x in range(size):
            raster.setSample(x, y, 0, int(values[y, x]))
    jvm.javax.imageio.ImageIO.write(im, "jpg", jvm.java.io.File(str(path)))


def test_files_end_to_end(spark, tmp_path):
    from planeprint import cli
    from planeprint.sources.files import list_files, read_images

    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (3, 3)).repeat(8, 0).repeat(8, 1)
    b = np.tile(np.arange(24) * 10, (24, 1))
    for name, plane in (("a.jpg", a), ("a copy.JPG", a), ("b.jpeg", b)):
        write_jpeg(spark, tmp_path / name, plane)
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "broken.jpg").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "sub").mkdir()
    write_jpeg(spark, tmp_path / "sub" / "c.jpg", a)
    d = str(tmp_path)
    assert len(list_files(spark, d, ["jpg", "jpeg"])) == 5 and len(list_files(spark, d, ["jpg", "jpeg"], True)) == 6 and len(list_files(spark, d)) == 6
    with pytest.raises(FileNotFoundError):
        list_files(spark, d, ["gif"])
    hashes = hashing.compute_hashes(read_images(spark, d, ["jpg", "jpeg"], True))
    rows = {os.path.basename(r.path): r for r in hashes.collect()}
    assert rows["a.jpg"].hash_hex == rows["a copy.JPG"].hash_hex == rows["c.jpg"].hash_hex != rows["b.jpeg"].hash_hex
    assert rows["empty.jpg"].reason == "empty file" and rows["broken.jpg"].w0 is None
    assert {r.stage: r.n for r in sinks.stage_counts(hashes).collect()} == {"listed": 6, "hashed": 4, "failed": 2}
    lines = []
    options = CommandOptions(d, "similar", recursive=True, output=d + "/out", print_only=True)
    cli.run(spark, options, out=lines.append)
    assert any("2 similar images" in x for x in lines) and all(os.path.exists(tmp_path / n) for n in ("a.jpg", "a copy.JPG"))
    got = spark.read.csv(d + "/out", header=True).collect()
    assert len(got) == 2 and {r.estimated_difference for r in got} == {"0"}
    gone = []
    found = cover.find_similar(hashing.with_dense_ids(hashes))
    n, _ = sinks.delete(found, CommandOptions(d, "similar", interactive=True), ask=lambda q: "y", remove=gone.append)
    assert n == len(gone) == 2
    assert sinks.delete(found, CommandOptions(d, "similar", auto_delete=True), ask=lambda q: "n") == (0, 0)
    assert cli.main([]) == 1 and cli.main(["hash", "-d", d + "/none"]) == 1


def test_stream(spark, tmp_path):
    from planeprint import streaming

    rng = np.random.default_rng(7)
    planes = rng.integers(0, 256, (4, 16, 16)).astype(np.uint8)
    rows = [(f"p{k}", bytearray(planes[k % 3].tobytes()), 16, 16) for k in range(4)]
    schema = "path string, luma binary, width int, height int"
    folder, store, matches = (str(tmp_path / n) for n in ("in", "store", "matches"))
    spark.createDataFrame(rows, schema).write.parquet(folder)
    q = streaming.store_and_match(streaming.hash_stream(spark, folder, schema), store, matches, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    found = spark.read.parquet(matches).collect()
    assert {(r.old, r.path, r.dist) for r in found} == {("p0", "p3", 0)}
