"""Suffix-array dedup: every byte covered by a 400-byte string that starts in two places is removed.

The suffix array is built by linear grouping (Baier 2016). Suffixes are grouped by their Lyndon prefix; groups are
processed in descending order, and the suffixes that previous-smaller pointers lead to get longer prefixes and move
to new groups right behind their own. A second pass over the result emits the order within each group. No names are
given anew and nothing recurses; symbols may be any integers.

A suffix array of all texts can't be in one task, so the texts are cut at content-defined anchors:

1. The anchor of a 400-byte window is the 64-byte gram with the least hash in it, the last of equal ones. It depends on
   the window alone, so equal windows have equal grams at equal offsets; each window has one anchor.
2. Anchors whose gram occurs once in the corpus are dropped, and with them the windows they stand for.
3. The windows of an anchor cover a region. Equal regions become one with a number of copies; the rest meets in shards
   by gram. There the texts right of the anchors, in ranked blocks of 40 bytes, form one string whose suffix array
   orders them; longest common prefixes of neighbours are then taken in bytes. The window
   that starts d bytes before its anchor occurs again if another anchor in its interval of common prefixes of 400 - d
   bytes has the same d bytes to the left.
4. A gram with more than MOST_ANCHORS different regions would not fit a task. Its windows are counted exactly by a
   128-bit digest instead, summed up before they are dealt out.

Texts with the same SHA-256 are one text with several places: it is indexed once per task, and all its bytes
go if it is long enough. Null text is empty text. Ids are never used as keys, so repeated and null ids are kept apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectext

GRAM = 64
BLOCK = 40
#: Regions of a shard, about; and of one gram, beyond which its windows are counted by digest.
SHARD_ANCHORS = 3000
MOST_ANCHORS = 16384


# --- the suffix array -----------------------------------------------------------------------------------


def suffix_array(text) -> list[int]:
    """The start positions of the suffixes of a sequence of integers in ascending order; a proper prefix comes first."""
    names = {c: i + 1 for i, c in enumerate(sorted(set(text)))}
    s = [names[c] for c in text]
    s.append(0)  # less than all others
    n = len(s)
    # groups by first symbol; a group is known by the place of its first member in order
    count = [0] * (len(names) + 2)
    for c in s:
        count[c + 1] += 1
    for c in range(len(names) + 1):
        count[c + 1] += count[c]
    fill = count[:]
    order, place, group = [0] * n, [0] * n, [0] * n
    for i, c in enumerate(s):
        k = fill[c]
        fill[c] = k + 1
        order[k] = i
        place[i] = k
        group[i] = count[c]
    size = [0] * (n + 1)  # of the group that begins at a place
    for c in range(len(names) + 1):
        size[count[c]] = fill[c] - count[c]
    smaller = [-2] * n  # the previous suffix of a smaller group; -1: none; -2: not known yet
    end = n
    while end > 0:
        begin = group[order[end - 1]]
        members = order[begin:end]
        times: dict[int, int] = {}
        for i in members:
            p = smaller[i]
            if p == -2:
                p = i - 1
                path = [i]
                while p >= 0:
                    g = group[p]
                    if g < begin:
                        break
                    if g == begin and smaller[p] == -2:
                        path.append(p)
                        p -= 1
                    else:
                        p = smaller[p]
                for q in path:
                    smaller[q] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            if len(times) == 1 or max(times.values()) == 1:
                levels = [times]
            else:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
            for level in levels:
                for p in level:  # to the end of its group
                    g = group[p]
                    size[g] -= 1
                    k, last = place[p], g + size[g]
                    if k != last:
                        other = order[last]
                        order[last], order[k] = p, other
                        place[p], place[other] = last, k
                fresh: dict[int, int] = {}
                for p in level:  # the ends are groups of their own
                    g = group[p]
                    new = fresh.get(g, -1)
                    if new < 0:
                        new = fresh[g] = g + size[g]
                        size[new] = 0
                    group[p] = new
                    size[new] += 1
        end = begin
    # each group's order: the suffix that begins where a Lyndon prefix ends decides
    out, given = [-1] * n, [0] * n
    out[0] = n - 1
    group[n - 1] = -1
    for i in range(n):
        j = out[i] - 1
        while j >= 0:
            g = group[j]
            if g < 0:
                break
            out[g + given[g]] = j
            given[g] += 1
            group[j] = -1
            j = smaller[j]
    return out[1:]


# --- anchors --------------------------------------------------------------------------------------------


def anchors(offsets: np.ndarray, data: np.ndarray, window: int, gram: int = GRAM):
    """(document, gram hash, anchor, first window, last window) of a slice of texts; places count from its start.

    Windows of one text whose anchor is the same are neighbours; they are one row."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < window:
        return none
    c, down = vectext.prefix_hash(data, vectext._VALUES)
    grams = n - gram + 1
    h = vectext.mix((c[gram:] - c[:grams]) * down[:grams])
    bits = max(1, int(grams - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    rank = (h & ~low) | (low - np.arange(grams, dtype=np.uint64))  # of equal grams the last is least
    width = window - gram + 1
    padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:grams] = rank
    blocks = padded.reshape(-1, width)
    to_right = np.minimum.accumulate(blocks, axis=1).ravel()
    to_left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - window + 1
    least = np.minimum(to_left[:starts], to_right[width - 1 : width - 1 + starts])
    at = (low - (least & low)).astype(np.int64)
    inside = np.zeros(starts + 1, np.int64)
    lengths = np.diff(offsets)
    for a, b in zip(offsets[:-1][lengths >= window].tolist(), offsets[1:][lengths >= window].tolist()):
        inside[a] += 1
        inside[b - window + 1] -= 1
    s = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(s):
        return none
    a = at[s]
    cut = np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(s)]]) - 1
    doc = np.searchsorted(offsets, s[first], "right") - 1
    return doc, h[a[first]].view(np.int64), a[first], s[first], s[last]


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """key, gram, at, lo, hi: the anchors of the distinct texts of each task."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            texts = batch.column(1).take(pa.array(new, pa.int64()))
            offsets, data = vectext.buffers(texts)
            for first, last in vectext.slices(offsets):
                at = offsets[first : last + 1] - offsets[first]
                doc, gram, a, lo, hi = anchors(at, data[offsets[first] : offsets[last]], window)
                if len(doc):
                    base = at[doc]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[new[first + d]] for d in doc.tolist()], pa.binary()), pa.array(gram), pa.array(a - base), pa.array(lo - base), pa.array(hi - base)], names=["key", "gram", "at", "lo", "hi"])

    return docs.select(common.text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(common.lean(run), "key binary, gram long, at long, lo long, hi long")


# --- shards ---------------------------------------------------------------------------------------------

_CUT = "digest binary, key binary, at long, gram long, left binary, right binary, copies long"
_REGION = "shard long, gram long, digest binary, left binary, right binary, copies long"
_RUNS = "digest binary, nearest long, farthest long"


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """texts(key, text, spots of gram, at, lo, hi) to two kinds of rows. For each anchor: digest of the region that its
    windows cover, key, at. For each different region of a batch: digest, gram, copies and, the first time that the task
    meets it, the text left and right of the anchor."""
    names = [x.split()[0] for x in _CUT.split(", ")]
    types = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())

    def run(batches):
        known: set[bytes] = set()
        for batch in batches:
            keys, texts_, lists = (batch.column(i).to_pylist() for i in range(3))
            for first in range(0, len(keys), 100):
                out: list[tuple] = []
                own: dict[bytes, list] = {}
                for key, text, spots in zip(keys[first : first + 100], texts_[first : first + 100], lists[first : first + 100]):
                    raw = text.encode()
                    for s in spots:
                        a, lo, hi = s["at"], s["lo"], s["hi"]
                        digest = hashlib.blake2b(raw[lo : hi + window], digest_size=16, salt=(a - lo).to_bytes(8, "little")).digest()
                        out.append((digest, key, a, None, None, None, None))
                        if digest in own:
                            own[digest][6] += 1
                        else:
                            new = digest not in known
                            known.add(digest)
                            own[digest] = [digest, None, None, s["gram"], raw[lo:a] if new else None, raw[a : hi + window] if new else None, 1]
                out += own.values()
                for k in range(0, len(out), 4000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 4000]), types)], names=names)

    return texts.mapInArrow(common.lean(run), _CUT)


def _window_digests(regions: DataFrame, window: int) -> DataFrame:
    """The windows of regions by digest: window, digest of the region, d, copies."""

    def run(batches):
        for batch in batches:
            for digest, left, right, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw, d = left + right, len(left)
                rows = [hashlib.blake2b(raw[w : w + window], digest_size=16).digest() for w in range(len(raw) - window + 1)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([digest] * n, pa.binary()), pa.array(range(d, d - n, -1), pa.int64()), pa.array([copies] * n, pa.int64())], names=["window", "digest", "d", "copies"])

    return regions.select("digest", "left", "right", "copies").mapInArrow(common.lean(run), "window binary, digest binary, d long, copies long")


def context_order(contexts: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of a byte matrix by the suffix array of its ranked blocks, common prefix of each with the next)."""
    m, length = contexts.shape
    columns = -(-length // block)
    words = np.zeros((m, columns * block), np.uint8)
    words[:, :length] = contexts
    parts = words.reshape(m * columns, block)
    wide = parts.view(">u8")
    by = np.lexsort([wide[:, k] for k in range(wide.shape[1] - 1, -1, -1)])
    differs = np.concatenate([[False], (wide[by[1:]] != wide[by[:-1]]).any(axis=1)])
    rank = np.empty(m * columns, np.int64)
    rank[by] = np.cumsum(differs) + 1
    text = np.zeros((m, columns + 1), np.int64)  # 0 ends a row
    text[:, :columns] = rank.reshape(m, columns)
    places = np.array(suffix_array(text.ravel().tolist()), np.int64)
    order = places[places % (columns + 1) == 0] // (columns + 1)
    differ = contexts[order[1:]] != contexts[order[:-1]]
    common_ = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return order, common_


def repeated(lefts: list[bytes], rights: list[bytes], copies: np.ndarray, window: int, gram: int = GRAM) -> np.ndarray:
    """For regions by row and d by column, whether the window that starts d bytes before the anchor occurs twice or more.

    A region's text left of its anchor says how far its windows reach, the one to its right how near. Regions of other
    grams never share an interval: their contexts differ within the gram."""
    m, span = len(lefts), window - gram + 1
    right = np.zeros((m, window), np.uint8)
    left = np.zeros((m, span), np.uint8)  # from the anchor leftwards
    for i, (a, b) in enumerate(zip(lefts, rights)):
        b = b[:window]
        right[i, : len(b)] = np.frombuffer(b, np.uint8)
        left[i, : len(a)] = np.frombuffer(a, np.uint8)[::-1]
    order, shared = context_order(right)
    left, copies = left[order], copies[order]
    nearest = np.array([window - len(b) for b in rights])[order]
    farthest = np.array([len(a) for a in lefts])[order]
    found = np.zeros((m, span), bool)
    h = np.zeros(m, np.uint64)
    for d in range(span):
        if d:
            h = vectext.mix(h * np.uint64(3) + vectext._VALUES[left[:, d - 1]])
        own = np.flatnonzero((nearest <= d) & (d <= farthest))
        if not len(own):
            continue
        interval = np.concatenate([[0], np.cumsum(shared < window - d)]).astype(np.uint64)
        _, back = np.unique(h[own] + vectext.mix(interval[own] + np.uint64(1)), return_inverse=True)
        found[order[own], d] = np.bincount(back, copies[own])[back] > 1
    return found


def _shard(window: int):
    def run(t: pa.Table) -> pa.Table:
        found = repeated(t["left"].to_pylist(), t["right"].to_pylist(), t["copies"].to_numpy(), window)
        edge = np.zeros((t.num_rows, found.shape[1] + 2), bool)
        edge[:, 1:-1] = found
        row, nearest = np.nonzero(edge[:, 1:] & ~edge[:, :-1])
        _, end = np.nonzero(~edge[:, 1:] & edge[:, :-1])
        return pa.table([t["digest"].take(pa.array(row, pa.int64())), pa.array(nearest, pa.int64()), pa.array(end - 1, pa.int64())], names=["digest", "nearest", "farthest"])

    return run


# --- the operator ---------------------------------------------------------------------------------------


def repeated_runs(docs: DataFrame, window: int = 400) -> DataFrame:
    """key, first, last: of each text with other texts' or its own strings, the starts of windows that occur again.

    Runs of one text may touch and, where a text was indexed by several tasks, be given twice."""
    spark = common.spark_of(docs)
    common.prepare(spark)
    spots = common.stored(_anchor_rows(docs, window), "anchors")
    often = common.stored(spots.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    spots = common.stored(common.keep_numbers(spots, common.number_filter(often, "gram"), "gram").join(often, "gram"), "spots")
    texts = docs.select(common.text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = _once_a_task(texts, common.key_filter(spots))
    # a text that several tasks indexed has each anchor once here
    lists = spots.groupBy("key").agg(F.collect_set(F.struct("gram", "at", "lo", "hi")).alias("spots"))
    cut = common.stored(_cut(texts.join(lists, "key").select("key", "text", "spots"), window), "regions")
    places = cut.where("key IS NOT NULL").select("digest", "key", "at")
    regions = cut.where("key IS NULL").groupBy("digest").agg(F.first("gram").alias("gram"), F.first("left", True).alias("left"), F.first("right", True).alias("right"), F.sum("copies").alias("copies"))
    regions = common.stored(regions, "distinct")
    shards = max(1, -(-regions.count() // SHARD_ANCHORS))
    hot = regions.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ANCHORS).select("gram")
    some_hot = hot.limit(1).count()
    few = regions.join(hot, "gram", "left_anti") if some_hot else regions
    few = few.select(F.pmod("gram", F.lit(shards)).alias("shard"), "gram", "digest", "left", "right", "copies")
    runs = few.groupBy("shard").applyInArrow(common.lean(_shard(window)), _RUNS)
    if some_hot:
        windows = common.stored(_window_digests(regions.join(hot, "gram", "left_semi"), window), "windows")
        twice = windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window")
        runs = runs.unionByName(windows.join(twice, "window").select("digest", F.col("d").alias("nearest"), F.col("d").alias("farthest")))
    return places.join(runs, "digest").select("key", (F.col("at") - F.col("farthest")).alias("first"), (F.col("at") - F.col("nearest")).alias("last"))


def _once_a_task(texts: DataFrame, wanted) -> DataFrame:
    def run(batches):
        bitset = wanted.value
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for k in batch.column(0).to_pylist():
                new = k not in seen and common.in_filter(bitset, k)
                if new:
                    seen.add(k)
                keep.append(new)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(common.lean(run), "key binary, text string")


def spans_of(first, last, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting at first to last cover, as (start, end)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last)):
        b += window
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, window: int = 400) -> tuple[DataFrame, DataFrame]:
    """(copies, cuts) of docs(text), both by the key of a text (common.text_key).

    copies: key, places: the texts that several rows have. If they have window bytes all of them go.
    cuts: key, text, spans (array of start, end in bytes): of the texts of one row that lose something, what goes."""
    texts = docs.select(common.text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    copies = common.stored(texts.groupBy("key").agg(F.count(F.lit(1)).alias("places")).where("places > 1"), "copies")
    runs = common.stored(repeated_runs(docs, window).join(copies, "key", "left_anti"), "runs")
    lists = runs.groupBy("key").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    cut = _once_a_task(texts, common.key_filter(runs)).join(lists, "key")

    def run(batches):
        for batch in batches:
            spans = [[{"start": x, "end": y} for x, y in spans_of(a, b, window)] for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["key", "text", "spans"])

    return copies, cut.select("key", "text", "first", "last").mapInArrow(common.lean(run), "key binary, text string, spans array<struct<start:long,end:long>>")


def kept_bytes(text: str, spans) -> bytes:
    raw = text.encode()
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join(out) + raw[at:]


def digest_removed(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs(doc_id, text)."""
    copies, cuts = remove_repeats(docs, window)

    def run(batches):
        for batch in batches:
            rows = [(k, sum(s["end"] - s["start"] for s in x), len(x), hashlib.sha256(kept_bytes(t, x)).hexdigest()) for k, t, x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "removed", "spans", "sha"])

    cuts = cuts.mapInArrow(common.lean(run), "key binary, removed long, spans long, sha string")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), common.text_key(F.col("text")).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    rows = rows.join(copies, "key", "left").join(cuts, "key", "left")
    gone = F.col("places").isNotNull() & (F.col("n_bytes") >= window)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """docs with what repeats taken out of text, columns as before; n_chars, where there is one, counts anew.

    A character of which bytes go, goes as a whole. Rows with the same text are the same row's copies and lose all of
    it; rows whose text becomes empty stay."""
    copies, cuts = remove_repeats(docs, window)

    def run(batches):
        for batch in batches:
            left = [kept_bytes(t, x).decode("utf-8", "ignore") for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["__key", "__left"])

    cuts = cuts.mapInArrow(common.lean(run), "__key binary, __left string")
    gone = F.col("__places").isNotNull() & (F.octet_length("text") >= window)
    out = docs.withColumn("__key", common.text_key(F.col("text"))).join(copies.toDF("__key", "__places"), "__key", "left").join(cuts, "__key", "left")
    out = out.withColumn("text", F.when(gone, F.lit("")).otherwise(F.coalesce("__left", "text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone | F.col("__left").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
