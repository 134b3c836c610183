"""Operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and empty tables."""

import collections
import functools
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeprint.llm import chat, common, hnsw, katz, licenses, mixing, ngram_join, packing, quality, suffix, urls, vectext

WORDS = "[^\\x20\\x09-\\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("wor", "Tal", "é", "xy") for b in ("a", "in", "öst", "ER.", "o,")]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = text(130)
    rows = []
    for i in range(n):
        t = text(rng.choice([0, 1, 3, 4, 5, 30, 80, 200]))
        if rows and rng.random() < 0.5:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        if rng.random() < 0.2:
            t = t[: len(t) // 2] + "\n" + passage + "\t" + t[len(t) // 2 :]
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "a b c"), (5, rows[5][1]), (n + 3, "na " * 3000), (n + 4, "x" * 900)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "k", 1) for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def classes(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return [find(i) for i in range(n)]


def test_words_and_shingles():
    import pyarrow as pa

    texts = [t for _, t in corpus(4)]
    sets = vectext.shingles(*vectext.buffers(pa.array(texts)))
    known = {}
    for t, got in zip(texts, sets):
        w = re.findall(WORDS, lower(t))
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(got) == len(want)
        known.setdefault(frozenset(want), got.tolist())
        assert known[frozenset(want)] == got.tolist()


def test_jaccard(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = re.findall(WORDS, lower(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = classes(len(rows), links)
    least = collections.defaultdict(list)
    for i, p in enumerate(part):
        least[p] += [rows[i].doc_id] if rows[i].doc_id is not None else []
    want = sorted(str((r.doc_id, len(s), r.doc_id if not s else min(least[p], default=None))) for r, s, p in zip(rows, sets, part))
    got = ngram_join.jaccard_join(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert links and ngram_join.jaccard_join(docs.where("false")).count() == 0


def jaccard_parts(rows):
    """Component of each row by brute force, None without words."""
    sets = []
    for r in rows:
        w = re.findall(WORDS, lower(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return [p if s else None for p, s in zip(classes(len(rows), links), sets)]


def one_a_part(rows):
    """Of each component the row with the smallest id (none: last), then text key; all rows without words."""
    best, out = {}, []
    for r, p in zip(rows, jaccard_parts(rows)):
        rank = (r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).digest()[:16], tuple(map(str, r)))
        if p is None:
            out.append(r)
        elif p not in best or rank < best[p][0]:
            best[p] = (rank, r)
    return out + [r for _, r in best.values()]


def unlike(k, n=120):
    return " ".join(f"w{k}x{i}" for i in range(n))


def test_one_row_of_each_component(spark, docs):
    a, b, c, d, e = (unlike(k) for k in "abcde")
    near = a.replace("x60", "y60")
    rows = [(3, a), (None, a), (7, a), (7, b), (1, c), (1, c), (None, d), (None, d), (9, e), (9, e + " z"), (None, near), (20, None), (20, None), (21, " "), (None, "")]
    rows = spark.createDataFrame([(i, t, "en", f"src{k % 2}", len(t or ""), "k", 1) for k, (i, t) in enumerate(rows)], DOCS).repartition(3)
    got = ngram_join.one_of_each(rows)
    assert got.columns == rows.columns
    have = got.collect()
    assert sorted(x.doc_id for x in have if x.text and x.text.strip() and x.doc_id) == [1, 3, 7, 9] and len(have) == 9
    both = rows.unionByName(docs)
    for df, out in ((rows, have), (both, ngram_join.one_of_each(both).collect())):
        assert sorted(map(str, out)) == sorted(map(str, one_a_part(df.collect())))
    # the suffix stage then finds no two equal texts, so no group leaves as a whole
    left = {r.text for r in suffix.without_repeats(got).collect()}
    assert {b, c, d} <= left and ({e, e + " z"} & left) and a in left
    assert ngram_join.one_of_each(rows.where("false")).count() == 0


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(100):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 250), replace=False)) for _ in "ab")
        a, b = sorted((a, b), key=len)
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        assert ngram_join.bound(len(a), x, np.array([len(b)]), ngram_join.folded(y, len(x))[None])[0] >= len(np.intersect1d(a, b))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 1)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    part = classes(80, edges[:-1])
    want = {(a, part[a]) for e in edges[:-1] for a in e if e[0] != e[1] and part[a] != a}
    for most in (10**6, 0):
        got = {(r.node, r.component) for r in common.components(df, most).collect() if r.node != r.component}
        assert got == want


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(500):
        s = [rng.randrange(rng.choice([1, 2, 4, 50])) for _ in range(rng.randrange(40))]
        s = (s[:3] * 12)[: len(s)] if rng.random() < 0.3 else s
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("most", [16384, 3])
def test_suffix_dedup(spark, docs, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_ANCHORS", most)
    rows = docs.select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in rows]
    count = collections.Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    want = []
    for r, b in zip(rows, raw):
        spans = suffix.spans_of(*zip(*[(i, i) for i in range(len(b) - 399) if count[b[i : i + 400]] > 1] or [(0, -400)]), 400) if len(b) >= 400 else []
        spans = [s for s in spans if s[1] > s[0]]
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)]))
        want.append(str((r.doc_id, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())))
    got = suffix.digest_removed(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(want)
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_suffix_dedup_of_nothing(spark, docs):
    assert suffix.digest_removed(docs.where("false")).count() == 0


def test_licenses(spark):
    texts = ["Released under the MIT License.", "relaesed under the MIT-License", "mit license mit license", "Apache\nLICENSE ... GNU General Public License", "summit licenses", None, "", "x " * 5000 + "mit license", "Licensd under the Apache License, Version 2.0"]
    got = licenses.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(i, k) for _, p, k in ((x[1], x[1].split(), x[0]) for x in licenses.BASE) for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert got[1].labels == "mit" and 0 < got[8].score and "apache" in got[8].labels and got[4].labels == ""


def test_license_windows_out_of_order():
    """A later hit whose window begins before an earlier one's, and a notice right before a closer one."""
    found = lambda text: [(x[0], x[3]) for x in licenses.scanner(licenses.NOTICES).find(licenses.normal(text)[0])]
    free = next(i for i, (label, w, k) in enumerate(licenses.NOTICES) if w.startswith("redistribution"))
    one = licenses.NOTICES[free][1]
    assert [x for x in found(one.replace("binary", "binry") + " " + one) if x[0] == free] == [(free, 1), (free, 0)]
    bounds = licenses.pieces(one, 4)
    changed = "".join(p if i == 4 else p[:2] + "X" + p[3:] for i, (_, p) in enumerate(bounds))
    assert [x for x in found(changed) if x[0] == free] == [(free, 4)]


def labels_of(text):
    return sorted({x[4] for x in licenses.scanner(licenses.NOTICES).find(licenses.normal(text)[0])})


def test_license_names_are_exact():
    assert labels_of("released under the MIT license") == ["mit"] and labels_of("Relesed undr the MIT licence") == ["mit"]
    assert labels_of("released under the GPL license") == ["gpl"] and labels_of("released under the BSD license") == ["bsd"]
    assert labels_of("released under the new license") == [] and labels_of("small rights reserved") == [] == labels_of("overall rights reserved")
    assert labels_of("licensed under CC BY-SA 4.0") == ["cc-by-sa"] and labels_of("licensed under CC BY-ND 4.0") == ["cc-by-nd"]
    assert labels_of("licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa"] and labels_of("All right reserved.") == ["proprietary"]
    assert labels_of("GNU Lesser General Public License") == ["gpl", "lgpl"]  # the base phrase stands there as well


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_license_edits_by_brute_force():
    """A notice without fixed words is found where some run of words is within its edits, and nowhere else."""
    rng = random.Random(9)
    for label, wording, k in (("x", "all rights reserved", 1), ("y", "redistribution and use in source and binary forms", 4)):
        s = licenses.Scanner(((label, wording, k),))
        for _ in range(150):
            w = list(wording)
            for _ in range(rng.randrange(k + 3)):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["q"], [w[at], "z"], [" "]])
            words, _ = licenses.normal("so " + "".join(w) + " then")
            split = words.split()
            runs = [" ".join(split[i:j]) for i in range(len(split)) for j in range(i + 1, len(split) + 1)]
            assert bool(s.find(words)) == any(edit_distance(r, wording) <= k for r in runs), words


def test_hnsw(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 60)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base[rng.integers(0, 30, 250)] + rng.normal(size=(250, 16)) * rng.choice([0, 0.05, 0.15], (250, 1))])
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 2)) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[0][1], None), (304, [None] * 16, 1), (305, rows[1][1], 1), (None, rows[1][1], 1), (306, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    v = [np.array(r[1], np.float32).astype(float) for r in ok]
    links = [(a, b) for a, b in itertools.combinations(range(len(ok)), 2) if ok[a][2] == ok[b][2] and len(v[a]) == len(v[b]) and v[a] @ v[b] / np.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= 0.98]
    n = collections.Counter(itertools.chain.from_iterable(links))
    part = classes(len(ok), links)
    ids = collections.defaultdict(list)
    for i, p in enumerate(part):
        ids[p] += [ok[i][0]] if ok[i][0] is not None else []
    want = {r[0]: (n[i], min(ids[part[i]])) for i, r in enumerate(ok)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()}
    found = sum(k for k, _ in got.values())
    assert found >= 0.98 * 2 * len(links) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want) and got[300] == (0, 300) and got[303] == (0, 303)
    assert hnsw.near_duplicates(df.where("false")).count() == 0


def test_graph_reaches_every_vertex():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(900, 16))
    v[:400] = v[0] + rng.normal(size=(400, 16)) * 0.03  # one dense group around a vertex
    keys = np.array([hashlib.sha256(x.tobytes()).digest()[:16] for x in v], "V16")
    u = hnsw.unit(v)
    graph = hnsw.build(keys, u)
    assert all(hnsw.reached(np.where(near >= 0, np.searchsorted(own, near), -1)).all() for own, near in graph)
    truth = u @ u.T >= 0.98
    found = hnsw.search(graph, u, u, hnsw.BEAM, 0.98)
    assert not (found & ~truth).any() and (found & truth).sum() >= 0.99 * truth.sum()
    marks, beam = hnsw.links_between(v, v, graph, 0.98, 1 << 10)
    assert beam == 900 and (marks == truth).all()


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b\\.c\\n", "<|image|> <s", "<s><s></s>\n", "", "<\\.s>", "é😀"]
    for t in texts:
        segment = chat.segment_of("user\n<s>", [{"type": "text", "text": t}])[0]
        assert chat.read_segment(segment) == ("user\n<s>", t)
        assert not any(c in segment[len(chat.OPEN) : -len(chat.CLOSE) - 1] for c in chat.CONTROLS)
    parts = [{"type": "text", "text": "see "}, {"type": "image", "uri": "i.png", "width": 64, "height": 33}, None, {"type": "audio", "uri": "a", "seconds": 1.01}, {"type": "document", "uri": "d", "pages": 2}, {"type": "film", "uri": "f"}]
    segment, start, length, attached, tokens = chat.segment_of("user", parts)
    assert [a["kind"] for a in attached] == ["image", "audio", "document", "document"] and [a["tokens"] for a in attached] == [4, 26, 1024, 512] and tokens == 1566
    assert all(segment[a["at"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in attached) and segment[start : start + length].startswith("see <|image|>")
    rows = [(1, k, ("user", "assistant", None)[k % 3], t) for k, t in enumerate(texts)] + [(2, 0, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in chat.digest(chat.format_messages(chat.text_messages(df))).collect()}
    one = "".join(f"{r or ''}\n{t}\n" for _, _, r, t in rows[:7])
    loss = "".join(t for _, _, r, t in rows[:7] if r == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(one.encode()).hexdigest() and (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].n_turns == 1 and got[2].loss_chars == 0 and got[None].n_turns == 1


def test_turns_that_tie_go_by_their_texts(spark):
    """What is escaped doesn't change their order; null role is the empty role; nothing of an empty table; clashing columns."""
    texts = ["a", "a!", "a\\", "a<s>", "a<", "", None, "a\n", "<s>", "<a"]
    rows = [(1, 0, role, t, "x", 5) for t in texts for role in ("user", "", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, loss_start long").repartition(5)
    got = chat.digest(chat.format_messages(chat.text_messages(df))).first()
    order = sorted((r or "", t or "") for _, _, r, t, _, _ in rows)
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert chat.digest(chat.format_messages(chat.text_messages(df.where("false")))).count() == 0


def test_url_lists_that_contradict_themselves(spark):
    rules = spark.createDataFrame([("a.org/", "block"), ("a.org/", "allow"), ("b.org", "block"), (None, "block")], "name string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "r"), (2, "http://x.b.org", "h", "r"), (3, "http://x.b.org/", "h", "r")], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, rules, rules.where("false")).collect()}
    assert got == {1: ("a.org/", "allow"), 2: (None, "allow"), 3: ("b.org/", "block")}
    assert urls.judge(pages.where("false"), rules, rules).count() == 0


def test_urls(spark):
    cases = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://x.com/fr/1", "http://x.com/de/", "http://xcom/fr/", None, "", "no", "ftp://com", "http://org", "http://b.net/", "http://www.cheap-pills.example.com/x", "http://org/#f", "a://b://c.org/x"]
    rules = spark.createDataFrame(list(urls.RULES), "name string, verdict string")
    listed = spark.createDataFrame([(x, "block") for x in urls.LISTED], "name string, verdict string")
    pages = spark.createDataFrame(list(enumerate(cases)) + [(0, cases[0])], "page_id long, url string")
    got = urls.judge(pages, rules, listed).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", cases[r.page_id] or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(n), n, v) for n, v in urls.RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith(n[n.index("/") :])]
        rule = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[1])
        assert r.verdict == (rule[2] or ("block" if "cheap-pills" in host else "allow"))


def good_turing(counts):
    """Discount factors of counts 1 to 5, from the formulas alone."""
    n = [0] + [sum(v == k for v in counts.values()) for k in range(1, 7)]
    fallback = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = {}
    for r in range(1, 6):
        d[r] = 1 - fallback / r
        if n[r] and n[1] and 6 * n[6] < n[1]:
            a = 6 * n[6] / n[1]
            x = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
            d[r] = x if 0 < x < 1 else d[r]
    return d


class KatzByHand:
    def __init__(self, texts, order):
        self.order, self.counts = order, [collections.Counter() for _ in range(order + 1)]
        for w in texts:
            padded = ["<start>"] * (order - 1) + w
            for k in range(1, order + 1):
                self.counts[k].update(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)))
        self.total, self.d = sum(self.counts[1].values()), [None] + [good_turing(c) for c in self.counts[1:]]
        self.after = collections.defaultdict(dict)
        for c in self.counts[2:]:
            for g, r in c.items():
                self.after[g[:-1]][g[-1]] = r
        left = sum((1 - self.d[1][r]) * r for r in self.counts[1].values() if r <= 5)
        self.all, self.unknown = (self.total, left / self.total) if left > 0 else (self.total + 1, 1 / (self.total + 1))
        self.seen, self.weight = functools.cache(self._seen), functools.cache(self._weight)

    def cut(self, k, r):
        return self.d[k].get(r, 1) * r

    def _seen(self, h):
        ws = self.after[h]
        c = sum(ws.values()) + (min(ws.values()) > 5)
        return {w: self.cut(len(h) + 1, r) / c for w, r in ws.items()}

    def _weight(self, h):
        return (1 - sum(self.seen(h).values())) / (1 - sum(self.p(w, h[1:]) for w in self.after[h]))

    def p(self, w, h):
        if not h:
            r = self.counts[1][(w,)]
            return self.cut(1, r) / self.all if r else self.unknown
        if h not in self.after:
            return self.p(w, h[1:])
        return self.seen(h)[w] if w in self.after[h] else self.weight(h) * self.p(w, h[1:])


@pytest.mark.parametrize(("order", "frequent"), [(1, 1000), (2, 1000), (3, 1000), (2, 1), (3, 20), (4, 50)])
def test_katz(spark, docs, monkeypatch, order, frequent):
    """Against a model by hand that shares no code; frequent histories are the same, wherever they begin."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 800)
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    rows = docs.select("doc_id", "text").collect()
    tokens = [[*re.findall(WORDS, lower(r.text)), "\n"] for r in rows]
    held = [zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 10 == 0 for r in rows]
    model = KatzByHand([w for w, out in zip(tokens, held) if not out], order)
    uni, total = model.counts[1], model.total
    for h in [(), *random.Random(1).sample(sorted(model.after), min(40, len(model.after)))]:  # distributions sum to 1
        assert abs(sum(model.p(w, h) for (w,) in uni) + model.p("unknown", h) - 1) < 1e-9
    want = []
    for r, w, out in zip(rows, tokens, held):
        padded = ["<start>"] * (order - 1) + w
        s = sum(math.log10(model.p(padded[i], tuple(padded[i - order + 1 : i]))) for i in range(order - 1, len(padded)))
        base = sum(math.log10((uni[(x,)] + 0.1) / (total + 0.1 * (len(uni) + 1))) for x in w)
        want.append((str(r.doc_id), out, len(w), sum((x,) in uni for x in w), total, base, s))
    got = sorted((str(r[0]), *r[1:]) for r in katz.score(docs, order).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_katz_of_nothing(spark, docs):
    assert katz.score(docs.where("false")).count() == 0
    one = katz.score(docs.sparkSession.createDataFrame([(0, "a b a")], "doc_id long, text string")).first()  # held out: no training text at all
    assert (one.n_known, one.train_tokens) in ((0, 0), (4, 4))


def test_packing(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        ids.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, path, 64).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r.length for r in rows) == total and len(seqs) == -(-total // 64)
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    for i, texts in ids.items():
        assert sorted(s for r in rows if r.doc_id == i for s in range(r.start, r.start + r.length)) == sorted(s for x in texts for s in range(len(x)))
    rng = random.Random(3)
    odd = ["a", " ", "  ", "\n", "'s", "7", "é", ".", "<|endoftext|>", "\x1c", "\xa0", "日本"]
    for _ in range(1000):
        t = "".join(rng.choice(odd) for _ in range(rng.randrange(10)))
        assert packing.encode(path, [t])[0] == packing.id_bytes(tokenizer.encode(t, add_special_tokens=False).ids)
    assert packing.pack(docs.where("false"), path).count() == 0


def test_texts_are_encoded_at_once(monkeypatch):
    """Ids are those of tokenizers, also of texts that are cut; what tiktoken merges is not split into words before."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    monkeypatch.setattr(packing, "AT_ONCE", 7)
    rng = random.Random(4)
    odd = ["a", "word", " ", "  ", "\n", "'s", "75", "é", ".", "\x1c", "\xa0", "\u3000", "日本"]
    for _ in range(1000):
        t = "".join(rng.choice(odd) for _ in range(rng.randrange(40)))
        assert encoder.encode(t) == packing.id_bytes(tokenizer.encode(t, add_special_tokens=False).ids)
    assert not len(encoder)
    t = "two words<|endoftext|> and  more"
    assert encoder.encode(t) == packing.id_bytes(tokenizer.encode(t, add_special_tokens=False).ids) and len(encoder)


def test_packed_sequences_can_be_read(spark, docs):
    """From the pieces alone: every sequence, and every document, token by token."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from planeprint.llm import queries

    path = public.path(queries.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    source = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(source, path, 64).collect()
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in source.collect()}
    documents, sequences = collections.defaultdict(dict), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        documents[r.doc_id][r.start] = ids
        sequences[r.sequence_id].append((r.offset, ids, r.doc_id, r.start))
    assert {i: [x for s in sorted(parts) for x in parts[s]] for i, parts in documents.items()} == want
    assert any(r.start % 64 for r in rows)  # some piece was cut
    for parts in sequences.values():
        own = []
        for at, ids, doc, start in sorted(parts):
            assert at == len(own) and ids == want[doc][start : start + len(ids)]
            own += ids
        assert len(own) <= 64
    assert "ids" in packing.pack(docs.where("false"), path).columns


def test_quality(spark, docs):
    rows = docs.select("doc_id", "text", "source").collect()
    got = quality.judge(docs)
    assert not [x for x in docs.columns if x not in got.columns] and quality.keep_good(docs).columns == docs.columns
    have = sorted((str(r.doc_id), r["__q_words"], r["__q_word_chars"], r["__q_symbols"], r["__q_dup_lines"], r["__q_repeat_words"], r["__q_base"]) for r in got.collect())
    want = []
    for r in rows:
        t = r.text or ""
        w = re.findall(WORDS, t)
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(WORDS, x)]
        want.append((str(r.doc_id), len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert have == sorted(want)
    bad = [(i, "x", "bad") for i in range(40)] + [(100 + i, "one two three four five six seven eight nine ten " + " ".join(f"w{i}{k}" for k in range(30)), s) for i, s in enumerate(["good"] * 40 + ["bad", None])]
    kept = quality.judge(spark.createDataFrame(bad, "doc_id long, text string, source string"))
    assert {r.doc_id for r in kept.where("__q_kept").collect()} == {*range(100, 140), 141}
    assert quality.keep_good(docs.where("false")).count() == 0


def test_mixing(spark):
    rows = [(i, "a b c d", ("en", "de", None)[i % 3], f"src{i % 6}") for i in range(60)] + [(None, "x y", "en", "src1"), (99, None, "en", "src1"), (3, "a b c d", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.select_mix(df, 0.5).collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    assert total // 2 - 20 <= sum(r.take_tokens for r in got) <= total // 2
    assert all(0 < r.take_tokens <= r.n_tokens and r.epoch < 2 for r in got)
    everything = mixing.select_mix(df, 5.0).collect()
    assert sum(r.take_tokens for r in everything) == 2 * total
    assert mixing.mixed(df, 0.5).columns == df.columns and mixing.select_mix(df.where("false")).count() == 0


def test_mixed_keeps_the_rows_that_are_taken(spark):
    """With ids null or repeated: the kept rows are those taken, in number and in tokens of each leaf."""
    rows = [(None, f"n{i} " * (i % 5 + 1), "en", f"src{i % 3}") for i in range(60)] + [(7, f"r{i} " * 4, ("en", "de", None)[i % 3], "src1") for i in range(40)]
    rows += [(8, "same text", "en", "src2")] * 20 + [(i, "a b c", "fr", None) for i in range(100, 120)] + [(None, None, "en", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    leaf = lambda r: str((r.doc_id, r.lang, r.source))
    for share in (0.3, 0.5, 1.0):
        taken = mixing.select_mix(df, share, max_epochs=1).collect()
        want = sorted((leaf(r), r.n_tokens) for r in taken)
        kept = mixing.mixed(df, share).collect()
        assert sorted((leaf(r), len(r.text.split())) for r in kept) == want
        assert not collections.Counter(map(tuple, kept)) - collections.Counter(rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    from planeprint.llm.common import table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
    assert kept["quality_rules"] > kept["jaccard_join"] >= kept["suffix_dedup"] > kept["mixing"] > 0
    assert json.dumps(kept) and docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
