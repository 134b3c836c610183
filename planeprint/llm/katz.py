"""LM scoring: a Katz backoff model with Good-Turing discounts and exactly normalised backoff weights.

Tokens are a text's words in lower case and one end; before the first stand starts. With c the counts of the training
tokens, N their number, h a history of words and h' the same without its first word:

    P(w)     = d(c(w)) c(w) / N  for words of the training texts; what the discounts leave is the unknown word's
    P(w | h) = d(r) r / C(h)     if r = c(h, w) > 0, else  a(h) P(w | h')
    a(h)     = what is left of h / (1 - sum of P(w | h') over the words seen after h);  1 if h was never seen

d(r) is Good-Turing's for r <= 5, of each order's own counts of counts, and 1 above. C(h) is c(h), or c(h) + 1 if all
counts after h are above 5, as nothing would be left otherwise. Each distribution sums to 1 over the known words, the
end and the unknown word. Orders up to ORDER are counted one after the other, and a token is evaluated from the
unigrams up.

Nothing of the corpus' size is in one place. Texts become blocks of about half a million tokens:

1. The blocks' words are dealt out by hash, counted and numbered, frequent words low; each block gets its words' counts
   and numbers. Numbers are exact: from here on no words are told apart by hashes.
2. For each order, a block's different n-grams go as numbers, with their training counts, to the bucket of their
   history without its first word. A bucket sums them up. It returns to each block the counts of its n-grams and, of histories that must back
   off there, what their weight depends on. These tables (order, bucket, block) are stored; the next order reads them,
   as an n-gram's history is an n-gram of the order before.
3. With all discounts known, each block evaluates its tokens and sums up its documents.

What a thousandth of all tokens or more have in common is dealt out by one word more: a history whose rest is frequent
by itself, a frequent history by n-gram. The sums of the latter over the buckets go through the driver: at most 1000
histories an order. Besides, only counts of counts go there. Null text is empty text: one token. A
document is held out if crc32(doc_id as text) mod 10 is 0; so is one without an id. Rows that repeat an id are scored
one by one. Words are hashed to 64 bits before they are numbered: two of n different words fall together with odds of
n * n / 2^65, which is 3e-8 for a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectext

#: Order of the model in production.
ORDER = 3
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Tokens of a block, n-grams of a bucket, words of a bucket of words.
BLOCK_TOKENS, BUCKET_TOKENS, BUCKET_WORDS = 500_000, 1_000_000, 1_000_000
#: What has 1 / FREQUENT of all tokens is dealt out by one word more. This changes no result.
FREQUENT = 1000
END = np.uint64(0x5BD1E9955BD1E995)


# --- arrays in binary columns ---------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the first bytes of all numbers, then the second ones and so on, compressed."""
    import zstandard

    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind == "i" and a.dtype.itemsize > 1 and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(int(a.max())))
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    text = ";".join(head).encode()
    return len(text).to_bytes(4, "little") + text + zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays again; unsigned numbers but 64-bit ones as 64-bit signed."""
    import zstandard

    n = int.from_bytes(blob[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0, []
    for spec in blob[4 : 4 + n].decode().split(";"):
        kind, size = spec.split(":")
        kind, size = np.dtype(kind), int(size)
        raw = np.frombuffer(body, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        a = np.ascontiguousarray(raw.T).reshape(-1).view(kind)
        out.append(a.astype(np.int64) if kind.kind == "u" and kind.itemsize < 8 else a)
        at += size * kind.itemsize
    return out


def risen(x: np.ndarray) -> np.ndarray:
    """Differences to the number before, signs in the lowest bit: small and alike where numbers ascend or repeat."""
    d = np.diff(x, prepend=0)
    return (d << 1) ^ (d >> 63)


def fallen(x: np.ndarray) -> np.ndarray:
    return np.cumsum((x >> 1) ^ -(x & 1))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[x for x, _ in fields])


def places_by(*columns: np.ndarray) -> np.ndarray:
    """The places of rows of numbers from 0, given by column, in their order; equal rows in the order of their places.

    Sorts numbers and places in one word where they fit, which is much faster than an argsort."""
    n = len(columns[0])
    bits = n.bit_length()
    order = None
    for x in columns[::-1]:
        x = x if order is None else x[order]
        if n and int(x.max()).bit_length() + bits < 64:
            at = np.sort((x.astype(np.int64) << bits) | np.arange(n)) & ((1 << bits) - 1)
        else:
            at = np.argsort(x, kind="stable")
        order = at if order is None else order[at]
    return order


def _groups(of: np.ndarray) -> list[np.ndarray]:
    """The places of equal numbers, in the order of these and of the places."""
    order = places_by(of)
    return np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(of) else []


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different words, which of these each is)."""
    coded = pa.array(words).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)


# --- the model ------------------------------------------------------------------------------------------


def discounts(counts_of_counts) -> np.ndarray:
    """d(0..DISCOUNTED) by Good-Turing from the numbers of types that occur 1, 2, ... DISCOUNTED + 1 times; d(0) is 0.

    Where these give no value within (0, 1), as in small corpora, it is 1 - D / r with D = n1 / (n1 + 2 n2)."""
    n = [0.0, *map(float, counts_of_counts)]
    k = DISCOUNTED
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = np.zeros(k + 1)
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - absolute / r
    return out


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(r <= DISCOUNTED, d[np.minimum(r, DISCOUNTED)], 1.0) * r


class Unigrams:
    """P(w) by the count of w; 0 stands for the unknown word."""

    def __init__(self, tokens: int, counts_of_counts):
        self.tokens = tokens
        self.d = discounts(counts_of_counts)
        r = np.arange(1, DISCOUNTED + 1)
        left = float(((1 - self.d[1:]) * r * np.array(counts_of_counts[:DISCOUNTED], float)).sum())
        self.all = tokens if left > 0 else tokens + 1  # without low counts the unknown word is given a count
        self.unknown = left / tokens if left > 0 else 1 / self.all

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.all, self.unknown)


def backoff(c, den, m, known, d) -> np.ndarray:
    """a(h). m: by history and r from 1 the n-grams that occur r times; known: sum of the lower order's P over h's words."""
    left = den - c + (m * ((1 - d[1:]) * np.arange(1, DISCOUNTED + 1))).sum(axis=1)
    return np.where(c > 0, left / np.maximum(den, 1) / np.maximum(1 - known, 1e-15), 1.0)


# --- blocks ---------------------------------------------------------------------------------------------

_BLOCK = "block string, docs binary, vocabulary binary, tokens binary, n_tokens long, n_words long"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents. docs: ids (0 and a mark where null), held out, tokens of each; vocabulary: distinct words,
    frequent first, and their training counts; tokens: their places in it."""

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids, nulls, held, sizes, hashes, n = [], [], [], [], [], 0

        def block():
            tokens, lengths = np.concatenate(hashes), np.concatenate(sizes)
            hashes.clear()
            out = np.concatenate(held)
            words, number = _distinct(tokens)
            order = np.argsort(-np.bincount(number, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            number = rank[number]
            train = np.bincount(number, np.repeat(~out, lengths), len(words)).astype(np.int64)
            row = (f"{task}-{made}", packed(np.concatenate(ids), np.concatenate(nulls), out, lengths), packed(words[order], train), packed(number), len(tokens), len(words))
            return _table([row], _BLOCK).to_batches()[0]

        for batch in batches:
            offsets, data = vectext.buffers(batch.column(1))
            own, null, out = (batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
            for first, last in vectext.slices(offsets):
                w, begin = vectext.words(offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]])
                hashes.append(np.insert(w, begin[1:], END))
                sizes.append(np.diff(begin) + 1)
                for held_, values in ((ids, own), (nulls, null), (held, out)):
                    held_.append(values[first:last])
                n += len(hashes[-1])
                if n >= BLOCK_TOKENS:
                    yield block()
                    made += 1
                    ids, nulls, held, sizes, hashes, n = [], [], [], [], [], 0
        if n:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(common.lean(run), _BLOCK)


# --- 1: words -------------------------------------------------------------------------------------------

_ANSWERS = "block string, level int, bucket int, answer binary"


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the counts and numbers (from 1) of the block's words there, in their order; under a null
    block, of each bucket the tokens, the words and how many of these occur 1, 2, ... times."""
    ask = "block string, bucket int, words binary"

    def deal(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        words, train = unpacked(t["vocabulary"][0].as_py())
        to = _word_bucket(words, buckets)
        return _table([(block, int(to[p[0]]), packed(words[p], train[p])) for p in _groups(to)], ask)

    def count(t: pa.Table) -> pa.Table:
        parts, bucket = [unpacked(x) for x in t["words"].to_pylist()], t["bucket"][0].as_py()
        words, at = _distinct(np.concatenate([p[0] for p in parts]))
        c = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.lexsort((words, -c))] = 1 + bucket + buckets * np.arange(len(words), dtype=np.int64)
        ends = np.cumsum([len(p[0]) for p in parts])
        rows = [(b, 1, bucket, packed(c[at[e - len(p[0]) : e]], number[at[e - len(p[0]) : e]])) for b, p, e in zip(t["block"].to_pylist(), parts, ends)]
        stats = [c.sum(), (c > 0).sum(), *(int((c == r).sum()) for r in range(1, DISCOUNTED + 2))]
        return _table([*rows, (None, 1, bucket, packed(np.array(stats, np.int64)))], _ANSWERS)

    asked = blocks.select("block", "vocabulary").groupBy("block").applyInArrow(common.lean(deal), ask)
    return asked.groupBy("bucket").applyInArrow(common.lean(count), _ANSWERS)


_NUMBERED = "block string, docs binary, words binary, tokens binary"


def _numbered(buckets: int, total: int, types: int):
    """A block with its words' numbers and counts, and with each document's known tokens and base score."""

    def run(t: pa.Table) -> pa.Table:
        ids, nulls, out, lengths = unpacked(t["docs"][0].as_py())
        words, _ = unpacked(t["vocabulary"][0].as_py())
        tokens = unpacked(t["tokens"][0].as_py())[0]
        c, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        to = _word_bucket(words, buckets)
        for x in t["answers"][0].as_py():
            c[to == x["bucket"]], number[to == x["bucket"]] = unpacked(x["answer"])
        first = np.cumsum(lengths) - lengths
        base = np.add.reduceat(np.log10((c + 0.1) / (total + 0.1 * (types + 1)))[tokens], first)
        known = np.add.reduceat((c > 0)[tokens].astype(np.int64), first)
        end = np.flatnonzero(words == END)
        docs = packed(ids, nulls.astype(np.int64), out.astype(np.int64), lengths, known, base)
        order = np.argsort(number)  # from here on words are in the order of their numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return _table([(t["block"][0].as_py(), docs, packed(risen(number[order]), c[order], c[end]), packed(rank[tokens]))], _NUMBERED)

    return run


# --- 2: n-grams -----------------------------------------------------------------------------------------


class Level:
    """A block's different n-grams of one order, by last word and then by history, and what is known of them.

    gram: of each token the place of the n-gram that ends there; history: of each token the place of its history among
    the n-grams of the order below, the last place being the starts before a document. h, w: those of each n-gram;
    numbers: columns of its words' numbers. r: its training count, once known; den: C of each history, once known."""

    def __init__(self, below: Level | None, tokens: np.ndarray, numbers: np.ndarray, starts: np.ndarray):
        if below is None:
            self.gram, self.numbers, self.n = tokens, [numbers], len(numbers)
            return
        self.history = np.empty(len(tokens), np.int64)
        self.history[1:] = below.gram[:-1]
        self.history[starts] = below.n
        key = tokens * (below.n + 1) + self.history
        order = places_by(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.gram = np.empty(len(order), np.int64)
        self.gram[order] = np.cumsum(new) - 1
        self.at, key = order[new], key[new]
        self.n = len(key)
        self.w, self.h = key // (below.n + 1), key % (below.n + 1)
        self.histories = [np.append(x, 0) for x in below.numbers]  # by place; the starts have the number 0
        self.numbers = [*(x[self.h] for x in self.histories), numbers[self.w]]

    def deal(self, rest: np.ndarray, often: int, buckets: int) -> list[np.ndarray]:
        """The n-grams' places by bucket, in its order, by history and last word. rest: by place of a history, the count
        of what it is without its first word; often: that of what is frequent."""
        x = np.zeros(self.n, np.uint64)
        for column in self.numbers[1:-1]:
            x = vectext.mix(x ^ column.astype(np.uint64))
        x = np.where(rest[self.h] >= often, vectext.mix(x + self.numbers[0].astype(np.uint64)), x)
        x = np.where(self.c[self.h] >= often, vectext.mix(x + self.numbers[-1].astype(np.uint64)), x)
        self.to = (x % np.uint64(buckets)).astype(np.int64)
        order = places_by(self.to, self.h)
        return np.split(order, np.flatnonzero(np.diff(self.to[order])) + 1)


class Counted:
    """What the driver knows once an order is counted: its discounts and, of its frequent histories, by their numbers the
    sum of the lower order's P and the n-grams that occur 1, 2, ... times."""

    def __init__(self) -> None:
        self.of_counts = np.zeros(DISCOUNTED + 1, np.int64)
        self.frequent: dict[tuple, tuple[float, np.ndarray]] = {}
        self.d = discounts(self.of_counts)

    def add(self, blob: bytes) -> None:
        of_counts, known, m, *numbers = unpacked(blob)
        self.of_counts += of_counts
        m = m.reshape(-1, DISCOUNTED)
        for i, h in enumerate(zip(*(x.tolist() for x in numbers))):
            a, b = self.frequent.get(h, (0.0, np.zeros(DISCOUNTED, np.int64)))
            self.frequent[h] = (a + float(known[i]), b + m[i])
        self.d = discounts(self.of_counts)


def _levels(row: dict, counted: list[Counted], often: int, buckets: int, upto: int):
    """(docs, starts of documents, levels 1 to upto) of a block. The levels but the last have their counts r, of their
    histories (by place) counts c and den, and for those that must back off known and m (else 0)."""
    docs = unpacked(row["docs"])
    numbers, c1, c_end = unpacked(row["words"])
    numbers, tokens = fallen(numbers), unpacked(row["tokens"])[0]
    starts = np.cumsum(docs[3]) - docs[3]
    level = Level(None, tokens, numbers, starts)
    level.r = c1
    levels = [level]
    answers = {(x["level"], x["bucket"]): x["answer"] for x in row["answers"] or ()}
    answered = {k for k, _ in answers}
    for k in range(2, upto + 1):
        below, level = level, Level(level, tokens, numbers, starts)
        level.c = np.append(below.r, c_end)  # every text has a start and an end
        rest = np.append(levels[-2].r[_suffix(below, levels[-2])], c_end) if k > 2 else np.full(len(level.c), often)
        level.parts = level.deal(rest, often, buckets)
        levels.append(level)
        if k not in answered:
            break  # the order that is counted now
        size = len(level.c)
        level.r, level.den = np.zeros(level.n, np.int64), np.zeros(size, np.int64)
        level.known, level.m = np.zeros(size), np.zeros((size, DISCOUNTED), np.int64)
        for p in level.parts:
            level.r[p], plus, need, known, m = unpacked(answers[k, int(level.to[p[0]])])
            hs = _runs(level.h[p])[0]
            level.den[hs] = level.c[hs] + plus
            level.known[hs[need]], level.m[hs[need]] = known, m.reshape(-1, DISCOUNTED)
        for i in np.unique(level.h[level.c[level.h] >= often]).tolist():
            known, m = counted[k].frequent.get(tuple(int(x[i]) for x in level.histories), (0.0, np.zeros(DISCOUNTED, np.int64)))
            level.den[i], level.known[i], level.m[i] = level.c[i] + (not m.any()), known, m
    return docs, starts, levels


def _suffix(level: Level, below: Level) -> np.ndarray:
    """Of each n-gram the place, one order below, of what it is without its first word."""
    return below.gram[level.at]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first places, lengths) of runs of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], first, np.diff(np.append(first, len(x)))


_GRAMS = "block string, bucket int, grams binary"


def _deal(order: int, counted: list[Counted], often: int, buckets: int):
    """Of a block, its n-grams of the order by bucket: histories' counts, their numbers of n-grams and the C of what they
    are without their first word; the n-grams' last words, training counts and counts one order below; the histories."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, _, levels = _levels(row, counted, often, buckets, order)
                level, below = levels[-1], levels[-2]
                train = np.bincount(level.gram, np.repeat(docs[2] == 0, docs[3]), level.n).astype(np.int64)
                lower = _suffix(level, below)
                rows = []
                for p in level.parts:
                    hs, at, sizes = _runs(level.h[p])
                    den = risen(below.den[below.h[lower[p[at]]]]) if order > 2 else np.zeros(0, np.int64)
                    *others, last = (x[hs] for x in level.histories)
                    rows.append((row["block"], int(level.to[p[0]]), packed(level.c[hs], sizes, den, level.numbers[-1][p], train[p], below.r[lower[p]], *others, risen(last))))
                    if len(rows) == 500:
                        yield from _table(rows, _GRAMS).to_batches()
                        rows = []
                if rows:
                    yield from _table(rows, _GRAMS).to_batches()

    return run


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of numbers, given by column: (a place of each different row, which of these each row is)."""
    order = places_by(*columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    return order[new], code


def _count(order: int, counted: list[Counted], unigrams: Unigrams, often: int):
    """Of a bucket, each block's answer: counts of its n-grams, of its histories C - c, and for those that must back off
    there (by place) the sum of the lower order's P and how many n-grams occur 1, 2, ... times. Under a null block what
    Counted.add() takes."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in t["grams"].to_pylist()]
        blocks, bucket = t["block"].to_pylist(), t["bucket"][0].as_py()
        del t
        sizes = [len(p[3]) for p in parts]
        own = np.concatenate([np.repeat(np.arange(len(p[0])), p[1]) for p in parts])  # history of each n-gram in its part
        begin = np.cumsum([0] + [len(p[0]) for p in parts])
        own += np.repeat(begin[:-1], sizes)
        columns = [np.concatenate([fallen(p[6 + i]) if i == order - 2 else p[6 + i] for p in parts]) for i in range(order - 1)]
        first_h, code = _same(*columns)
        columns = [x[first_h] for x in columns]
        c = np.concatenate([p[0] for p in parts])[first_h]
        hist = code[own]
        first, pair = _same(hist, np.concatenate([p[3] for p in parts]))
        r = np.bincount(pair, np.concatenate([p[4] for p in parts]), len(first)).astype(np.int64)
        of, seen = hist[first], r > 0
        low = np.concatenate([p[5] for p in parts])[first]
        if order == 2:
            p_low = unigrams(low)
        else:
            below = np.concatenate([fallen(p[2]) for p in parts])[first_h][of]
            p_low = discounted(low, counted[order - 1].d) / np.maximum(below, 1)
        m = np.stack([np.bincount(of[r == k], minlength=len(c)) for k in range(1, DISCOUNTED + 1)], axis=1).astype(np.int64)
        known = np.bincount(of[seen], p_low[seen], len(c))
        plus = (~m.any(axis=1)).astype(np.int64)
        rows, at = [], 0
        for i, block in enumerate(blocks):
            k = sizes[i]
            rr, hs = r[pair[at : at + k]], code[begin[i] : begin[i + 1]]
            need = _runs(own[at : at + k][rr == 0] - begin[i])[0] if (rr == 0).any() else np.zeros(0, np.int64)
            rows.append((block, order, bucket, packed(rr, plus[hs], need, known[hs[need]], m[hs[need]].ravel())))
            at += k
        hot = np.flatnonzero(c >= often)
        stats = packed(np.array([int((r == k).sum()) for k in range(1, DISCOUNTED + 2)], np.int64), known[hot], m[hot].ravel(), *(x[hot] for x in columns))
        return _table([*rows, (None, order, bucket, stats)], _ANSWERS)

    return run


# --- 3: scores ------------------------------------------------------------------------------------------

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _evaluate(order: int, counted: list[Counted], unigrams: Unigrams, often: int, buckets: int):
    """A block's documents to scores: each token's probability from the unigrams up to the order."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, starts, levels = _levels(row, counted, often, buckets, order)
                ids, nulls, out, lengths, known, base = docs
                p = unigrams(levels[0].r)[levels[0].gram]
                for k, level in enumerate(levels[1:], 2):
                    d, r = counted[k].d, level.r[level.gram]
                    weight = backoff(level.c, level.den, level.m, level.known, d)
                    p = np.where(r > 0, discounted(r, d) / np.maximum(level.den[level.history], 1), weight[level.history] * p)
                score = np.add.reduceat(np.log10(p), starts)
                arrays = [pa.array(ids, pa.int64(), mask=nulls.astype(bool)), pa.array(out.astype(bool)), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def _answered(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """blocks with a list of what the buckets of all orders answered them."""
    if not answers:
        return blocks.withColumn("answers", F.lit(None).cast("array<struct<level:int,bucket:int,answer:binary>>"))
    both = answers[0]
    for x in answers[1:]:
        both = both.unionByName(x)
    lists = both.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "answer")).alias("answers"))
    return blocks.join(lists, "block", "left")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text).

    base_score is the text's log10 probability with each count raised by 0.1; score is the model's."""
    common.prepare(common.spark_of(docs))
    raw = common.stored(_blocks(docs), "blocks")
    tokens, words = raw.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    word_buckets = max(12, -(-(words or 0) // BUCKET_WORDS))
    buckets = max(12, -(-(tokens or 0) // BUCKET_TOKENS))
    answers = common.stored(_word_counts(raw, word_buckets), "words")
    stats = sum((unpacked(x.answer)[0] for x in answers.where("block IS NULL").select("answer").toLocalIterator()), np.zeros(DISCOUNTED + 3, np.int64))
    total, types = int(stats[0]), int(stats[1])
    unigrams = Unigrams(total, [int(x) for x in stats[2:]])
    often = max(1, -(-total // FREQUENT))
    asked = _answered(raw.select("block", "docs", "vocabulary", "tokens"), [answers]).groupBy("block")
    blocks = common.stored(asked.applyInArrow(common.lean(_numbered(word_buckets, total, types)), _NUMBERED), "numbered")
    common.drop(raw, answers)
    counted = [Counted() for _ in range(order + 1)]
    orders: list[DataFrame] = []
    for k in range(2, order + 1):
        grams = _answered(blocks, orders).mapInArrow(common.lean(_deal(k, counted, often, buckets)), _GRAMS)
        orders.append(common.stored(grams.groupBy("bucket").applyInArrow(common.lean(_count(k, counted, unigrams, often)), _ANSWERS), f"order{k}"))
        for row in orders[-1].where("block IS NULL").select("answer").toLocalIterator():
            counted[k].add(row.answer)
    scored = _answered(blocks, orders).mapInArrow(common.lean(_evaluate(order, counted, unigrams, often, buckets)), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
