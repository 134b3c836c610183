"""License scans: fuzzy search for short notices.

Texts are read as words of letters, digits and characters beyond ASCII, in lower case, with one space between them. A
notice is a wording with up to k characters put in, left out or changed, from the start of a word to the end of one; the
words that name the license, in braces, must stand there unchanged. What may change is split into k + 1 pieces, of which
one then stands in the text as it is (pigeonhole); one Aho-Corasick automaton finds the pieces of all notices in
one pass. Around each hit the regex library's bounded-error matching looks for the notice, and reports its place and
edits. Of matches that overlap and have different labels the one with more unchanged characters counts. Notices with
k = 0 are whole words; those always count.

Null or empty text has no words and no labels. Texts are read as a whole, one at a time. Ids aren't used.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Names of licenses in running text, by label.
NAMES = {
    "mit": ("mit", "expat"),
    "apache": ("apache", "apache 2 0"),
    "bsd": ("bsd", "2 clause bsd", "3 clause bsd", "new bsd", "simplified bsd"),
    "gpl": ("gpl", "gplv2", "gplv3", "gnu gpl", "gnu general public"),
    "lgpl": ("lgpl", "lgplv2 1", "lgplv3", "gnu lgpl", "gnu lesser general public"),
    "agpl": ("agpl", "agplv3", "gnu agpl", "gnu affero general public"),
    "mpl": ("mpl", "mozilla public"),
    "epl": ("epl", "eclipse public"),
    "cddl": ("cddl", "common development and distribution"),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "boost": ("boost software",),
    "artistic": ("artistic", "perl artistic"),
    "postgresql": ("postgresql",),
    "python": ("python software foundation", "psf"),
    "wtfpl": ("wtfpl",),
    "ofl": ("sil open font", "open font"),
    "odbl": ("odbl", "open database"),
    "unlicense": ("unlicense",),
    "cc0": ("cc0", "cc zero"),
}
#: Where names stand, and the edits allowed around them.
TEMPLATES = (
    ("released under the {} license", 3),
    ("licensed under the {} license", 3),
    ("distributed under the {} license", 3),
    ("available under the {} license", 3),
    ("under the terms of the {} license", 4),
)
#: Creative Commons by its elements: code, and the same in words.
ELEMENTS = (("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"))
#: (label, wording, edits allowed); what has no edits is the contract's base.
BASE = (("mit", "mit license", 0), ("apache", "apache license", 0), ("gpl", "general public license", 0))
NOTICES = (
    BASE
    + tuple((tuple((name, label) for label, names in NAMES.items() for name in names), w, k) for w, k in TEMPLATES)
    + tuple((f"cc-{code.replace(' ', '-')}", f"licensed under {{cc {code}}}", 2) for code, _ in ELEMENTS)
    + tuple((f"cc-{code.replace(' ', '-')}", f"{{creative commons}} {{{words}}}", 0) for code, words in ELEMENTS)
    + (
        ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
        ("apache", "licensed under the {apache} license version {2 0}", 3),
        ("gpl", "gnu {general public} license", 2),
        ("lgpl", "gnu {lesser general public} license", 2),
        ("lgpl", "gnu {library general public} license", 2),
        ("agpl", "gnu {affero general public} license", 2),
        ("mpl", "{mozilla public} license", 1),
        ("epl", "{eclipse public} license", 1),
        ("bsd", "redistribution and use in source and binary forms", 4),
        ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used", 6),
        ("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
        ("zlib", "this software is provided as is without any express or implied warranty in no event", 6),
        ("boost", "{boost software} license version", 2),
        ("unlicense", "this is free and unencumbered software released into the public domain", 5),
        ("cc0", "{cc0} public domain dedication", 2),
        ("proprietary", "all rights reserved", 1),
    )
)

_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def normal(text: str) -> tuple[str, int]:
    """(the words with one space around each, their number)."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD).split()
    return (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else "", len(words)


def parts_of(wording: str) -> list[tuple[str, bool]]:
    """(text, whether it must stand unchanged) of a wording; braces without text take a name of the notice's list."""
    out = []
    for i, part in enumerate(wording.replace("}", "{").split("{")):
        if part or i % 2:
            out.append((part, bool(i % 2)))
    return out


def pieces(wording: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece): edits + 1 parts of even length of what may change. Places leave out empty braces."""
    free, place = [], 0
    for part, fixed in parts_of(wording):
        if not fixed:
            free.append((place, part))
        place += len(part)
    total, out, used = sum(len(x) for _, x in free), [], 0
    for i, (at, part) in enumerate(free):  # pieces by the share of the length, one at least, none across a fixed part
        n = edits + 1 - len(out) if i == len(free) - 1 else max(1, min(edits + 1 - len(out) - (len(free) - 1 - i), round((edits + 1) * (used + len(part)) / total) - len(out)))
        cuts = [len(part) * j // n for j in range(n + 1)]
        out += [(at + a, part[a:b]) for a, b in zip(cuts, cuts[1:])]
        used += len(part)
    return out


class Scanner:
    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.names = [dict(label) if not isinstance(label, str) else None for label, _, _ in notices]
        self.labels = [label if isinstance(label, str) else None for label, _, _ in notices]
        self.edits = [k for _, _, k in notices]
        self.base = [(label, w, k) in BASE for label, w, k in notices]
        self.sizes, self.slack, self.patterns = [], [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, wording, k) in enumerate(notices):
            names = sorted(self.names[i] or (), key=lambda x: (-len(x), x))
            plain = wording.replace("{", "").replace("}", "")
            if not k:
                pattern = regex.escape(f" {plain} ")
            else:
                pattern = "".join(("(?P<name>" + "|".join(map(regex.escape, names)) + ")" if not part else regex.escape(part)) if fixed else f"(?:{regex.escape(part)}){{e<={k}}}" for part, fixed in parts_of(wording))
                pattern = rf"(?e)(?<=\ ){pattern}(?=\ )"
            self.patterns.append(regex.compile(pattern))
            self.sizes.append(len(plain))
            self.slack.append(k + max(map(len, names), default=0))
            for at, piece in pieces(wording, k) if k else [(0, f" {plain} ")]:
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in places.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def find(self, words: str) -> list[tuple[int, int, int, int, str]]:
        """(notice, start, end, edits, label) in the normal form of a text, by start."""
        near: dict[int, list[tuple[int, int]]] = {}
        out: list[tuple[int, int, int, int, str]] = []
        for last, (size, uses) in self.automaton.iter(words):
            first = last - size + 1
            for i, at in uses:
                if not self.edits[i]:
                    out.append((i, first + 1, last, 0, self.labels[i]))
                    continue
                a, b = max(0, first - at - self.slack[i] - 1), min(len(words), first - at + self.sizes[i] + self.slack[i] + 1)
                near.setdefault(i, []).append((a, b))
        for i, windows in near.items():
            spans: list[list[int]] = []
            for a, b in sorted(windows):  # a later hit of a later piece may begin before an earlier one's window
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            for a, b in spans:
                for m in self.patterns[i].finditer(words, a, b):
                    if (edits := sum(m.fuzzy_counts)) <= self.edits[i]:
                        out.append((i, m.start(), m.end(), edits, self.names[i][m["name"]] if self.names[i] else self.labels[i]))
        return sorted(self._nearest(out), key=lambda x: (x[1], x[0]))

    def _nearest(self, found):
        """Of overlapping matches with different labels, those with more unchanged characters, and all of the base."""
        kept: list[tuple[int, int, int, int, str]] = []
        for x in sorted(found, key=lambda x: (-(x[2] - x[1] - 2 * x[3]), x[0], x[1])):
            if self.base[x[0]] or not any(x[1] < y[2] and y[1] < x[2] and x[4] != y[4] for y in kept):
                kept.append(x)
        return kept


@lru_cache(maxsize=4)
def scanner(notices) -> Scanner:
    return Scanner(notices)


SCAN = "n_words long, notices array<struct<label:string,notice:int,first_word:long,last_word:long,edits:int,chars:int>>"


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """doc_id, n_words and the notices of each row of docs(doc_id, text): label, number in the list, words from 0, edits, characters."""
    common.prepare(common.spark_of(docs))

    def run(batches):
        s = scanner(notices)
        kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("chars", pa.int32())]))
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                words, n = normal(text or "")
                own, at, word = [], 0, -1
                for i, a, b, edits, label in s.find(words):
                    word += words.count(" ", at, a)
                    at = a
                    first = max(word, 0) if words[a] != " " else word + 1
                    own.append({"label": label, "notice": i, "first_word": first, "last_word": first + words[a:b].strip().count(" "), "edits": edits, "chars": b - a})
                counts.append(n)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "notices"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run), f"doc_id long, {SCAN}")


def digest(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """scan() summed up: n_base, first_word and last_word of the base, labels, score (1 - edits a character)."""
    found = scan(docs, notices)
    exact = F.array(*(F.lit(x in BASE) for x in notices))
    base = F.filter("notices", lambda x: F.get(exact, x["notice"]))
    firsts = F.transform("base", lambda x: x["first_word"])
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    score = F.array_max(F.transform("notices", lambda x: 1.0 - x["edits"] / x["chars"]))
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("notices").alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"),
    )
