"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection.

A document's set holds the distinct shingles of five words. Documents link when the Jaccard similarity of their
sets is 0.75 or more; the result gives each document the smallest id that it reaches by links.

1. Shingles that many documents share are put last in one global order of shingles (an order can't change results).
   Two linked documents then share a shingle among the first quarter of each set (prefix filter, Chaudhuri et al.
   2006, Xiao et al. 2008), and the smaller of them among the first seventh.
2. These prefixes are dealt out to buckets by hash. The documents of one prefix shingle, sorted by size, are a tile;
   a document's band of sizes there is 3/4 to 4/3 of its own, and less if the shingle comes late in its order: of two
   linked documents' common shingles the first leaves room for all others behind it (positional filter). Documents
   without a possible partner leave the tile.
3. In a tile, documents of different components meet as bitmaps: bit h mod width is the parity of the shingles there.
   Different bits are at most the size of the symmetric difference, which bounds the overlap from above (Sandes et
   al. 2020). Only the best partner of each document goes on.
4. What the bound lets through is decided by intersecting the two sorted arrays. Verified links are united to components.
5. A first round takes the LEAD first shingles of each order, where most links show. From then on only those members of
   all tiles count that have a possible partner in another component, so that bitmaps of a large group aren't sent to each of
   its tiles. 3 and 4 are repeated, later with all partners, until no pair is left that the bound lets through. Every
   link then lies within a component, while neither pairs within a component nor copies of a set are ever expanded.

Null or empty text: empty set, linked with nothing. Null id: takes part, its result is under a null id.
Rows that repeat an id with other text are not linked by it. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectext

#: Shingles found this often in one part of the input take part in the count of frequent ones.
LOCAL_FREQUENT = 8
#: The most frequent shingles that are put last; bounds what is broadcast (1 MB).
MOST_FREQUENT = 1 << 17
#: Shingles of documents for a bucket (an eighth to a quarter are in prefixes), least number of buckets, and documents
#: of a tile that meet at once in the first round.
BUCKET_SHINGLES = 5_000_000
LEAST_BUCKETS = 24
BLOCK = 1024
#: Shingles of each order that the first round takes. This changes no result.
LEAD = 4
#: Bits of a bitmap for each shingle, rounded up. Unlike sets then differ in about half of them, those that may link in less
#: than a third; more bits cost bytes in every bucket and spare little.
WIDER = 1


def overlap_least(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def prefix_lengths(n: int, num: int = 75, den: int = 100) -> tuple[int, int]:
    """(length of the prefix, part of it that also holds for the smaller document of a pair)."""
    if not n:
        return 0, 0
    return n - overlap_least(n, num, den) + 1, n - overlap_least(n, 2 * num, den + num) + 1


def step_of(n, num: int = 75, den: int = 100):
    """What places in the prefix of a set of n are divided by, and rounded down, to fit a byte."""
    return np.maximum(1, -(-(n - -(-n * num // den) + 1) // 256))


def reach_of(n: np.ndarray, place: np.ndarray, num: int = 75, den: int = 100) -> np.ndarray:
    """The largest set that a set of n can link with if their first common shingle is at this place (by step_of)."""
    return (n - place * step_of(n, num, den)) * (den + num) // num - n


def width_of(n: int) -> int:
    """Bits of a set's bitmap: WIDER times its size rounded up to a power of two, 64 at least."""
    return max(64, WIDER << (n - 1).bit_length() if n > 1 else 0)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    width = width_of(len(hashes))
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (along the last axis) of a smaller width: parities of parts add up."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def bound(n: int, own: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The overlap of a set of n with each of others is at most this."""
    differ = np.bitwise_count(others ^ own).sum(axis=-1, dtype=np.int64)
    return np.minimum((n + sizes - differ) // 2, np.minimum(n, sizes))


def enough(overlap, n, m, num: int = 75, den: int = 100):
    return den * overlap >= num * (n + m - overlap)


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(the shingles that most documents share, sorted by hash, at most MOST_FREQUENT; number of shingles)."""

    def run(batches):
        held: list[np.ndarray] = []
        n = 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= LOCAL_FREQUENT], c[c >= LOCAL_FREQUENT]
            return pa.RecordBatch.from_arrays([pa.array([*h.view(np.int64), None]), pa.array([*c, n], pa.int64())], names=["h", "c"])

        for batch in batches:
            sets = vectext.shingles(*vectext.buffers(batch.column(0)), size)
            held += sets
            n += sum(map(len, sets))
            if n > 4_000_000:
                yield counted()
                held, n = [], 0
        if held:
            yield counted()

    counts = common.stored(docs.select("text").mapInArrow(common.lean(run), "h long, c long"), "frequent")
    total = counts.where("h IS NULL").agg(F.sum("c")).first()[0] or 0
    top = counts.where("h IS NOT NULL").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64)), total


_SIGNATURES = "doc_id long, row binary, n long, key binary, bits binary, bucket int, keys binary, sizes binary, counts binary, hashes binary, places binary"


def _signatures(docs: DataFrame, size: int, num: int, den: int, frequent, buckets: int) -> DataFrame:
    """Two kinds of rows. For each document doc_id, row (of docs, or null), n, key (128 bits of its set) and, for the first of equal sets of a
    batch of a task, bits. For each bucket that the prefixes of a batch reach: keys and sizes of the sets, counts of
    their prefix shingles there, the shingles (32 bits of their hash besides those that choose the bucket), and their
    places in the set's order, divided by step_of()."""
    types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *(pa.binary(),) * 5)
    names = [x.split()[0] for x in _SIGNATURES.split(", ")]

    def run(batches):
        last = frequent.value
        seen: set[bytes] = set()
        for batch in batches:
            ids, own_rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows: list[tuple] = []
            fresh: list[tuple] = []
            for i, s in enumerate(vectext.shingles(*vectext.buffers(batch.column(1)), size)):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                if key is None or key in seen:
                    rows.append((ids[i], own_rows[i], len(s), key, None, None, None, None, None, None, None))
                    continue
                seen.add(key)
                rows.append((ids[i], own_rows[i], len(s), key, bitmap(s).tobytes(), None, None, None, None, None, None))
                probe, _ = prefix_lengths(len(s), num, den)
                if len(last):
                    at = np.searchsorted(last, s)
                    at[at == len(last)] = 0
                    often = last[at] == s
                    s = np.concatenate([s[~often], s[often]])
                fresh.append((key, len(s), s[:probe]))
            if fresh:
                h = np.concatenate([x[2] for x in fresh])
                who = np.repeat(np.arange(len(fresh)), [len(x[2]) for x in fresh])
                places = np.concatenate([np.arange(len(x[2])) // step_of(x[1], num, den) for x in fresh]).astype(np.uint8)
                to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                keys, sizes = np.array([x[0] for x in fresh], "V16"), np.array([x[1] for x in fresh], np.int32)
                for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    own, counts = np.unique(who[part], return_counts=True)
                    rows.append((None, None, None, None, None, int(to[part[0]]), keys[own].tobytes(), sizes[own].tobytes(), counts.astype(np.int32).tobytes(), h[part].astype(np.uint32).tobytes(), places[part].tobytes()))
            for k in range(0, len(rows), common.ARROW_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + common.ARROW_ROWS]), types)], names=names)

    row = F.col("row") if "row" in docs.columns else F.lit(None).cast("binary").alias("row")
    return docs.select(F.col("doc_id").cast("long"), "text", row).mapInArrow(common.lean(run), _SIGNATURES)


_MEMBERS = "lead boolean, bucket int, key binary, n long, hashes binary, places binary"
#: Up to this many neighbours by size are looked at one by one for a possible partner in a tile.
NEIGHBOURS = 8


def _partnered(h: np.ndarray, n: np.ndarray, reach: np.ndarray, comp: np.ndarray, num: int, den: int) -> np.ndarray:
    """Marks of the prefix shingles (hash, size and reach of their set, component) whose tile may hold a partner."""
    order = np.lexsort((n, h))
    ho, no, reach, comp = h[order], n[order], reach[order], comp[order]
    near = np.zeros(len(order), bool)
    for d in range(1, min(NEIGHBOURS, len(order) - 1) + 1):
        fits = (ho[d:] == ho[:-d]) & (no[d:] <= reach[:-d]) & (no[:-d] <= reach[d:]) & (comp[d:] != comp[:-d])
        near[d:] |= fits
        near[:-d] |= fits
    cuts = np.flatnonzero(np.diff(ho)) + 1
    first, last = np.concatenate([[0], cuts]), np.append(cuts, len(ho))
    for k in np.flatnonzero(last - first > NEIGHBOURS + 1).tolist():  # in wider tiles, whoever has one of another component in its band
        a, b = first[k], last[k]
        number = np.unique(comp[a:b], return_inverse=True)[1]
        rest = number != np.bincount(number).argmax()
        sizes, others = no[a:b], no[a:b][rest]  # those of all components but the largest
        low, high = np.searchsorted(others, -(-num * sizes // den)), np.searchsorted(others, reach[a:b], "right")
        # a member of these finds at least itself; if it finds no other one there may still be one of the largest
        near[a:b] |= (high > low) | rest
    out = np.zeros(len(order), bool)
    out[order] = near
    return out


def _members(t_bucket: int, lead: bool, keys, sizes, rows: np.ndarray, h: np.ndarray, places: np.ndarray) -> pa.Table:
    """The members of a bucket by row: key, size, hashes and places of what is kept. rows must ascend."""
    parts = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1) if len(rows) else []
    ids = [int(rows[p[0]]) for p in parts]
    columns = ([lead] * len(ids), [t_bucket] * len(ids), [bytes(keys[i]) for i in ids], [int(sizes[i]) for i in ids], [h[p].tobytes() for p in parts], [places[p].tobytes() for p in parts])
    types = (pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(columns, types)], names=["lead", "bucket", "key", "n", "hashes", "places"])


def _reduce(num: int, den: int, leads: int):
    def run(t: pa.Table) -> pa.Table:
        """Of a bucket, the sets and shingles that share a tile with another set of their band of sizes: those among the
        first ones of the orders, and all."""

        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(t[name].to_pylist()), kind)

        keys, sizes, counts, h, places = joined("keys", "V16"), joined("sizes", np.int32), joined("counts", np.int32), joined("hashes", np.uint32), joined("places", np.uint8)
        lead = np.zeros(len(keys), bool)  # equal sets of several tasks once
        lead[list({k: i for i, k in enumerate(keys.tolist())}.values())] = True
        rows = np.repeat(np.arange(len(keys)), counts)
        out = []
        for first in (True, False):
            use = np.flatnonzero(lead[rows] & (places < leads) if first else lead[rows])
            n = sizes[rows[use]].astype(np.int64)
            use = use[_partnered(h[use], n, reach_of(n, places[use].astype(np.int64), num, den), rows[use], num, den)]
            out.append(_members(t["bucket"][0].as_py(), first, keys, sizes, rows[use], h[use], places[use]))
        return pa.concat_tables(out)

    return run


def _open(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        """Of a bucket, the members and shingles that share a tile with a possible partner in another component."""
        t = t.combine_chunks()
        rows, h, reach = _flat(t, num, den)
        comp = np.unique(np.array(t["component"].to_pylist(), object), return_inverse=True)[1]
        n = t["n"].to_numpy()
        keep = _partnered(h, n[rows], reach, comp[rows], num, den)
        places = vectext.buffers(t["places"].combine_chunks())[1]
        return _members(t["bucket"][0].as_py(), False, t["key"].to_pylist(), n, rows[keep], h[keep], places[keep])

    return run


def _flat(t: pa.Table, num: int, den: int):
    """(row, hash, reach) of every prefix shingle of a bucket's members."""
    at, raw = vectext.buffers(t["hashes"].combine_chunks())
    rows = np.repeat(np.arange(t.num_rows), np.diff(at) // 4)
    places = vectext.buffers(t["places"].combine_chunks())[1].astype(np.int64)
    return rows, np.frombuffer(raw.tobytes(), np.uint32), reach_of(t["n"].to_numpy()[rows], places, num, den)


_PAIRS = "a binary, b binary, score double, a_part binary, b_part binary"


def _tiles(num: int, den: int, mode: str):
    """The tiles of a bucket to pairs that the bitmap bound lets through.

    Partners are in other components. mode: "block" takes the best one of each set within blocks of a tile, and looks
    through the whole tile only for sets without one; "near" the best of the tile, "best" the best one in each other
    component, "all" all of them. Besides, all but "block" return under a null b every set that has a partner: as
    components only grow, the others never will."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rows, h, reaches = _flat(t, num, den)
        n = t["n"].to_numpy()
        parts, comp = np.unique(np.array(t["component"].to_pylist(), object), return_inverse=True)
        width = np.array([width_of(int(x)) // 64 for x in n])
        bits = [np.frombuffer(x, np.uint64) for x in t["bits"].to_pylist()]
        order = np.lexsort((comp[rows], n[rows], h))
        cuts = np.flatnonzero(h[order][1:] != h[order][:-1]) + 1
        best: dict[tuple, tuple] = {}
        done: set[bytes] = set()
        live = np.zeros(len(n), bool)

        def offer(x: int, y: int, score: float) -> None:
            a, b = (x, y) if x < y else (y, x)
            if mode == "all":
                best[a, b] = (score, a, b)
                return
            for own, other in ((x, y), (y, x)):
                slot = (own, int(comp[other]) if mode == "best" else 0)
                if slot not in best or (score, -a, -b) > (best[slot][0], -best[slot][1], -best[slot][2]):
                    best[slot] = (score, a, b)

        for part in np.split(order, cuts) if len(order) else []:
            r, reach = rows[part], reaches[part]
            same = r.tobytes() + reach.tobytes()
            if len(r) < 2 or same in done:
                continue
            done.add(same)
            c, sizes = comp[r], n[r]
            if (c == c[0]).all():
                continue
            # a set meets the larger ones within its reach that reach it; sizes ascend
            ends = np.searchsorted(sizes, reach, "right")
            words = width[r]
            matrix: dict[int, np.ndarray] = {}

            def at_width(w: int, r=r, matrix=matrix) -> np.ndarray:
                if w not in matrix:
                    first_wide = int(np.searchsorted(words, w))
                    matrix[w] = np.zeros((len(r), w), np.uint64)
                    for k in range(first_wide, len(r)):
                        if sizes[k] * num > den * 64 * w:
                            break
                        matrix[w][k] = folded(bits[r[k]], w)
                return matrix[w]

            def meet(i: int, js: np.ndarray) -> bool:
                """Set i with sets js, all smaller or all larger, of its band and of other components."""
                hit = False
                for w in np.unique(np.minimum(words[i], words[js])).tolist():
                    own = js[np.minimum(words[i], words[js]) == w]
                    m = at_width(w)
                    most = bound(int(sizes[i]), m[i], sizes[own], m[own])
                    ok = np.flatnonzero(enough(most, sizes[i], sizes[own], num, den))
                    if not len(ok):
                        continue
                    hit = True
                    live[r[i]] = True
                    live[r[own[ok]]] = True
                    score = most[ok] / (sizes[i] + sizes[own[ok]] - most[ok])
                    if mode == "all":
                        pick = np.arange(len(ok))
                    elif mode == "best":
                        ranked = np.lexsort((-score, c[own[ok]]))
                        pick = ranked[np.concatenate([[True], np.diff(c[own[ok]][ranked]) != 0])]
                    else:
                        pick = [int(score.argmax())]
                    for k in pick:
                        offer(int(r[i]), int(r[own[ok[k]]]), float(score[k]))
                return hit

            def larger(i: int, lo: int, hi: int) -> np.ndarray:
                return lo + np.flatnonzero((c[lo:hi] != c[i]) & (reach[lo:hi] >= sizes[i]))

            begins = np.searchsorted(sizes, -(-num * sizes // den))
            if mode == "block":
                for i in np.flatnonzero(ends > np.arange(1, len(r) + 1)).tolist():
                    hi = int(ends[i])
                    near = min(hi, (i // BLOCK + 1) * BLOCK)
                    if not meet(i, larger(i, i + 1, near)) and near < hi:
                        meet(i, larger(i, near, hi))
                # sets that no smaller one chose, or met, look for a smaller one themselves
                for j in range(1, len(r)):
                    if (int(r[j]), 0) not in best:
                        own = int(begins[j]) + np.flatnonzero((c[begins[j] : j] != c[j]) & (reach[begins[j] : j] >= sizes[j]))
                        meet(j, own[sizes[own] <= reach[j]])
            else:
                # sets of the tile's largest component meet those of others only, which then look both ways
                number = np.unique(c, return_inverse=True)[1]
                large = int(np.bincount(number).argmax())
                in_large = np.flatnonzero(number == large)
                for i in np.flatnonzero(number != large).tolist():
                    meet(i, larger(i, i + 1, max(i + 1, int(ends[i]))))
                    own = in_large[np.searchsorted(in_large, begins[i]) : np.searchsorted(in_large, i)]
                    meet(i, own[(reach[own] >= sizes[i]) & (sizes[own] <= reach[i])])
        keys = t["key"].combine_chunks()
        found = list({(a, b): s for s, a, b in best.values()}.items())
        own = t["component"].combine_chunks()
        has = np.flatnonzero(live).tolist() if mode != "block" else []
        a, b = (pa.array([x[0][i] for x in found] + rest, pa.int64()) for i, rest in ((0, has), (1, [None] * len(has))))
        return pa.table([keys.take(a), keys.take(b), pa.array([float(x[1]) for x in found] + [None] * len(has), pa.float64()), own.take(a), own.take(b)], names=["a", "b", "score", "a_part", "b_part"])

    return run


def _sets(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(key, hashes) of the documents whose set has one of keys, once for each set; chance may add others."""
    wanted = common.key_filter(keys)

    def run(batches):
        bitset = wanted.value
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for s in vectext.shingles(*vectext.buffers(batch.column(0)), size):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and key not in seen and common.in_filter(bitset, key):
                    seen.add(key)
                    out.append((key, s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], names=["key", "hashes"])

    return docs.select("text").mapInArrow(common.lean(run), "key binary, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) and whether they link, by exact intersection of their sorted arrays."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok.append(bool(enough(both, len(x), len(y), num, den)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "links"])

    x = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(common.lean(run), "a binary, b binary, links boolean")


def _linked(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, row, n and key of every row of docs(doc_id, text) or docs(doc_id, text, row). key is that of the component,
    null for an empty set; row goes through as it is."""
    spark = common.spark_of(docs)
    common.prepare(spark)
    top, total = _frequent(docs, size)
    frequent = spark.sparkContext.broadcast(top)
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_SHINGLES))
    signatures = common.stored(_signatures(docs, size, num, den, frequent, buckets), "signatures")
    dealt = signatures.where("bucket IS NOT NULL").select("bucket", "keys", "sizes", "counts", "hashes", "places")
    signatures = signatures.where("bucket IS NULL").select("doc_id", "row", "n", "key", "bits")
    all_members = common.stored(dealt.groupBy("bucket").applyInArrow(common.lean(_reduce(num, den, LEAD)), _MEMBERS), "members")
    all_bits = signatures.where("bits IS NOT NULL").select("key", "bits")

    def with_part(rows: DataFrame) -> DataFrame:
        if parts is None:
            return rows.withColumn("component", F.col("key"))
        rows = rows.join(parts.withColumnRenamed("node", "key"), "key", "left")
        return rows.withColumn("component", F.coalesce("component", "key"))

    def bits_of(rows: DataFrame) -> DataFrame:
        bits = common.keep_filtered(all_bits, common.key_filter(rows)).groupBy("key").agg(F.first("bits").alias("bits"))
        return common.stored(bits, "bits")

    links = tried = parts = sets = None
    members = all_members.where("lead")
    bits = bits_of(members)
    mode = "block"
    while True:
        tiles = with_part(members.join(bits, "key")).select("bucket", "key", "n", "hashes", "places", "bits", "component")
        found = tiles.groupBy("bucket").applyInArrow(common.lean(_tiles(num, den, mode)), _PAIRS)
        if mode != "block":
            found = common.stored(found, "met")
            live = found.where("b IS NULL").select(F.col("a").alias("key"))
            if not live.limit(1).count():
                break
            live = common.key_filter(live)
            members, bits = (common.stored(common.keep_filtered(x, live), name) for x, name in ((members, "members"), (bits, "bits")))
            if sets is None:  # whoever may still have a partner has one by its bitmap
                sets = common.stored(_sets(docs, bits, size), "sets")
            found = found.where("b IS NOT NULL")
        if mode != "all":  # over all buckets, each set's best partner; then that in each other component
            if tried is not None:
                done = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
                found = found.join(done, ["a", "b"], "left_anti")
            both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "score", F.col("b_part").alias("a_part"), F.col("a_part").alias("b_part")))
            both = both.groupBy("a", *(["b_part"] if mode == "best" else [])).agg(F.max(F.struct("score", "b")).alias("m"))
            found = both.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
        else:
            found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = common.stored(found.select("a", "b").distinct(), "pairs")
        new = False
        if found.limit(1).count():
            pairs = found if tried is None else found.join(tried, ["a", "b"], "left_anti")
            keys = found.select(F.explode(F.array("a", "b")).alias("key"))
            wanted = _sets(docs, keys, size) if sets is None else common.keep_filtered(sets, common.key_filter(keys))
            judged = common.stored(_verify(pairs, wanted, num, den), "judged")
            tried = judged.select("a", "b") if tried is None else tried.unionByName(judged.select("a", "b"))
            linked = judged.where("links").select("a", "b")
            links = linked if links is None else links.unionByName(linked)
            if new := bool(linked.limit(1).count()):
                parts = common.stored(common.components(links), "parts")
        if mode == "block":  # now all tiles, as far as they hold several components
            opened = with_part(all_members.where("NOT lead")).groupBy("bucket").applyInArrow(common.lean(_open(num, den)), _MEMBERS)
            members = common.stored(opened, "members")
            bits = bits_of(members)
            mode = "near"
        elif not new:
            if mode == "all":
                break
            mode = {"near": "best", "best": "all"}[mode]

    # equal sets share a key; a key's rows are at one component
    nodes = signatures.select("doc_id", "row", "n", "key")
    if parts is not None:
        nodes = nodes.join(parts.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "row", "n", F.coalesce("component", "key").alias("key"))
    return nodes


def jaccard_join(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text). See the module's text."""
    nodes = _linked(docs.select("doc_id", "text"), size, num, den)
    least = nodes.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("component_id"))
    return nodes.join(least, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of docs without near duplicates: of each component exactly one row stays.

    It is that with the smallest doc_id; rows without an id come last. Of several texts under this id the one with the
    smallest text key stays, of rows that repeat both the first by their other columns. Documents without words all stay."""
    row = common.text_key(F.col("text"))
    linked = _linked(docs.select("doc_id", "text", row.alias("row")), size, num, den).where("key IS NOT NULL")
    linked = common.stored(linked.select("key", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row"), "joined")
    stay = linked.groupBy("key").agg(F.min(F.struct("none", "id", "row")).alias("m"))
    stay = stay.select(F.col("m.none").alias("__none"), F.col("m.id").alias("__id"), F.col("m.row").alias("__row"))
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    at, number = ["__none", "__id", "__row"], F.col("doc_id").cast("long")
    rows = docs.where(words).withColumn("__none", number.isNull()).withColumn("__id", F.coalesce(number, F.lit(0))).withColumn("__row", row)
    # tasks drop repeats of a row before they are dealt out, so many of one row are no large group
    order = Window.partitionBy(*at).orderBy(*([c for c in docs.columns if c not in ("doc_id", "text")] or ["__row"]))
    rows = rows.withColumn("__k", F.row_number().over(order)).where("__k <= 1")
    return rows.join(stay, at, "left_semi").select(*docs.columns).unionByName(docs.where(~words))
