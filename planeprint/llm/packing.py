"""Packing: shortest-pack-first over the histogram of lengths, joined back to documents by rank.

A document becomes tokens and an end; whole sequences are cut off its front, the rest is a piece. Only the histogram of
piece lengths (2048 numbers at most) goes to the driver. There the lengths are placed longest first, each into the
pack with the most room (Krell et al. 2021), many equal pieces at a time: packs with the same history are one entry with
a count. A new pack is opened while fewer are open than all tokens need; after that a length that fits nowhere is cut at
the room of the shortest pack and its tail goes back into the histogram, so that less than one sequence of padding is
left. The result is a table of placements whose size depends on the sequence length alone. Pieces are ranked within
their length by sums over salts, so that no length is sorted in one task, and look their placement up by rank. Every
piece carries its ids; a sequence is its pieces' ids in the order of their offsets.

Null text is empty text: one piece that holds the end. Ids may be null or repeat; each row is packed.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Least number of salts within a length, and pieces of one length and salt, about, beyond it.
SALTS, SALTED = 64, 100_000
#: Distinct words whose ids a Python worker remembers, and the longest of them, where it goes by words.
REMEMBERED, LONGEST = 100_000, 60
#: Characters that tiktoken gets at once, about.
AT_ONCE = 1_000_000


# --- tokens ---------------------------------------------------------------------------------------------

#: Where a text can be cut so that its parts give its ids: before a space at the start of white space, or that is the
#: last of it. There the vocabulary's pattern always ends a piece.
_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
_ODD = re.compile(r"\s \s")
#: Fixed value: how the byte-level vocabulary's tokenizer splits text before it merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def id_bytes(ids) -> bytes:
    """Ids as 32-bit numbers in little-endian order."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder(dict):
    """The ids that tokenizers gives. Texts are merged by tiktoken, with ranks from the same file, if its ids are in the
    order of its merges and its splitting is that of the byte-level pattern.

    Others, and texts with special tokens, go by the words that follow a space, whose ids are remembered; all are forgotten
    when full. Of these words, those that tiktoken may not merge are left to tokenizers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor") or model.get("ignore_merges"):
            return None
        vocab, letters = model["vocab"], _byte_letters()
        made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        if made != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        special = set(self.special)
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def part(self, text: str) -> bytes:
        """The ids of a text or of a part cut at _CUT."""
        if self.fast is None or any(x in text for x in self.special):
            return id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return id_bytes(self.fast(text))

    def __missing__(self, word: str) -> bytes:
        ids = self.part(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not any(x in text for x in self.special):
            if len(text) <= AT_ONCE:
                return id_bytes(self.fast(text))
            out, at = [], 0
            while at < len(text):
                cut = _CUT.search(text, at + AT_ONCE)
                end = cut.start() if cut else len(text)
                out.append(id_bytes(self.fast(text[at:end])))
                at = end
            return b"".join(out)
        if "  " in text or _ODD.search(text):
            return b"".join([self[x[1:]] if x[0] == " " else self.part(x) for x in _CUT.split(text) if x])
        words = text.split(" ")
        first = words.pop(0)
        ids = b"".join(map(self.__getitem__, words))
        return self.part(first) + ids if first else ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(path: str, texts: list[str]) -> list[bytes]:
    """Of each text the ids of the tokenizer file at path, as little-endian 32-bit numbers."""
    return [encoder(path).encode(x) for x in texts]


# --- placements -----------------------------------------------------------------------------------------


def place(counts: dict[int, int], most: int) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Placements by length: (first rank, sequence of it, offset there, length placed, first rank of the tails).

    Rank r of the length, from one first rank to the next, goes to sequence + (r - first rank). If less than the length
    is placed, the tail is a piece of the remaining length, at first rank of the tails + (r - first rank)."""
    total = sum(k * n for k, n in counts.items())
    need = -(-total // most)
    left = dict(counts)  # pieces by length, with tails
    opened = 0
    packs: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, number of them)
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    rooms: list[int] = []  # ascending

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in packs:
                packs[room] = []
                rooms.insert(bisect_right(rooms, room), room)
            packs[room].append((first, n))

    for length in range(most, 0, -1):
        n, rank = left.get(length, 0), 0
        while n:
            room = rooms[-1] if rooms else 0
            if room >= length or (room and opened >= need):
                first, k = packs[room].pop()
                if not packs[room]:
                    del packs[room]
                    rooms.pop()
                take = min(n, k)
                put(room, first + take, k - take)
                part = min(room, length)
                tails = left.get(length - part, 0) if part < length else 0
                if part < length:
                    left[length - part] = tails + take
                put(room - part, first, take)
                out.setdefault(length, []).append((rank, first, most - room, part, tails))
            else:
                take = n if opened >= need else min(n, need - opened)
                out.setdefault(length, []).append((rank, opened, 0, length, 0))
                put(most - length, opened, take)
                opened += take
            n, rank = n - take, rank + take
    return out


def locate(placements, firsts, length: int, rank: int):
    """The parts of a piece: (start in it, length, sequence, offset)."""
    start = 0
    while True:
        rank0, sequence, offset, part, tails = placements[length][bisect_right(firsts[length], rank) - 1]
        yield start, part, sequence + rank - rank0, offset
        if part == length:
            return
        start, length, rank = start + part, length - part, tails + rank - rank0


# --- the operator ---------------------------------------------------------------------------------------


def _pieces(docs: DataFrame, tokenizer: str, most: int, end: int) -> DataFrame:
    """doc_id, key, doc_tokens, start, length, ids: whole sequences off each document's front, then its rest.

    The ids of a document that has none beyond 16 bits are 16-bit numbers, which _wide() undoes."""
    tail = id_bytes([end])

    def run(batches):
        for batch in batches:
            ids, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for doc, key, raw in zip(ids, keys, encode(tokenizer, texts)):
                own = np.frombuffer(raw + tail, "<u4")
                n = len(own)
                own = own.astype("<u2") if own.max() < 1 << 16 else own
                rows += [(doc, key, n, s, min(most, n - s), own[s : s + most].tobytes()) for s in range(0, n, most)]
            long = pa.int64()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (long, pa.binary(), long, long, long, pa.binary()))], names=["doc_id", "key", "doc_tokens", "start", "length", "ids"])

    docs = docs.select(F.col("doc_id").cast("long"), common.text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(common.lean(run), "doc_id long, key binary, doc_tokens long, start long, length long, ids binary")


def _wide(ids: bytes, length: int) -> bytes:
    """The ids of a piece of the length as 32-bit numbers."""
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if len(ids) == 2 * length else ids


def _ranked(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """pieces with their rank from 0 among those of the same length: a rank within a salt, and the salts' sums before."""
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "start"), F.lit(salts)))
    sums = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sums = sums.select(F.col("length").alias("l"), F.col("salt").alias("s"), before.alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "key", "start")
    ranked = pieces.withColumn("r", F.row_number().over(order) - 1)
    at = (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))
    return ranked.join(sums, at).select("doc_id", "doc_tokens", "start", "length", "ids", (F.col("r") + F.col("before")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end: int = 1) -> DataFrame:
    """docs(doc_id, text) as pieces: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ids are little-endian 32-bit numbers. A piece that is cut has a row for each part, with the part's ids."""
    spark = common.spark_of(docs)
    common.prepare(spark)
    pieces = common.stored(_pieces(docs, tokenizer, most, end), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # most rows
    placements = place(counts, most)
    table = spark.sparkContext.broadcast((placements, {k: [x[0] for x in v] for k, v in placements.items()}))

    def run(batches):
        where, firsts = table.value
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for doc, n, start, length, ids, rank in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids = _wide(ids, length)
                for s, part, sequence, offset in locate(where, firsts, length, rank):
                    rows.append((doc, start + s, part, ids[4 * s : 4 * (s + part)], n, sequence, offset))
            long = pa.int64()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (*(long,) * 3, pa.binary(), *(long,) * 3))], names=names)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    placed = _ranked(pieces, max(SALTS, max(counts.values(), default=0) // SALTED)).mapInArrow(common.lean(run), schema)
    return placed.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
