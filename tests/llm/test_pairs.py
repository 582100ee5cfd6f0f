"""The joins and searches on texts against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import bytesnp, common, ngram_join, suffix_dedup
from tracelake.llm.common import connected_components
from tracelake.llm.decontaminate import benchmark_matches, contamination, decontaminate, tile

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=5):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    held, head = defaultdict(list), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            held[x].append(d)

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, s in sets.items():
        for b, n in Counter(b for x in s for b in held[x] if b < a).items():
            if 100 * n >= 80 * (len(s) + len(sets[b]) - n):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed=5):
    random.seed(seed)
    base = [[f"w{random.randint(0, 4000)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(220):
        words = list(base[i % 4])
        for _ in range(random.randint(0, 3)):
            words[random.randrange(len(words))] = f"e{random.randint(0, 10**6)}"
        if i % 3 == 0:
            words = words[: random.randint(30, 60)]
        if i % 5 == 0:
            words = [f"u{random.randint(0, 10**6)}" for _ in range(25)] + [f"c{j}" for j in range(12)]
        rows.append((i, " ".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b c d"), (1005, " \t\n"), (1006, rows[0][1]), (1007, rows[0][1]), (1008, "Ünï cödé é " * 8)]


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, monkeypatch, small):
    if small:  # many tiles, and common shingles pushed back
        for name, value in (("TILE", 6), ("TEXT_TILE", 6), ("HOT_BLOCK", 400), ("HOT_LOCAL", 4), ("BROADCAST_ROWS", 0), ("WEIGH", 40)):
            monkeypatch.setattr(ngram_join, name, value)
        monkeypatch.setattr(common, "HOT", 10)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, rep string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs).collect()}
    assert got == components(rows)


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_gives_every_link(spark, monkeypatch, small):
    if small:
        for name in ("TILE", "TEXT_TILE", "PART"):
            monkeypatch.setattr(ngram_join, name, 7)
    rows = [*corpus(), (3, "q1 q2 q3 q4 q5 q6"), (3, corpus()[4][1] + " more")]  # two rows share a doc_id with a third
    for docs in (rows[:-2], rows):
        class_of, sets = {}, defaultdict(list)
        for d, t in docs:
            sets[frozenset(shingles(t))].append(d)
        class_of = {x: min(ds) for x, ds in sets.items() if x}
        want = defaultdict(int)
        for (x, a), (y, b) in itertools.combinations(class_of.items(), 2):
            both = len(x & y)
            if a != b and 100 * both >= 80 * (len(x) + len(y) - both):
                want[min(a, b), max(a, b)] = max(want[min(a, b), max(a, b)], both)
        table = spark.createDataFrame(docs, "doc_id long, text string")
        _, links = ngram_join.ngram_jaccard_links(table)
        got = [tuple(r) for r in links.collect()]
        assert len(got) == len(set(got)) and {(a, b): n for a, b, n in got} == want
        assert len(want) > len({d for pair in want for d in pair})
        n_links = Counter(d for pair in want for d in pair)
        counted = ngram_join.ngram_jaccard_components(table).collect()
        assert all(r["n_links"] == n_links[r["class_id"]] for r in counted)


def test_ngram_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_jaccard_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.ngram_jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 1, 2)], key=repr)
    again = spark.createDataFrame([*rows, (3, None), (3, None), (4, "")], "doc_id long, text string").withColumns({"Rep": F.lit("clash"), "n": F.lit(1)})
    kept = ngram_join.deduplicate(again)
    assert kept.columns == again.columns and sorted((r[0] or 0, r[1] or "") for r in kept.collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (2, "x y z"), (3, ""), (4, "")]
    kept = ngram_join.deduplicate(spark.createDataFrame(corpus(), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in components(corpus()).values()})


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def removed(rows, length):
    seen = Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def digests(docs, length=400):
    rows = suffix_dedup.repeat_digests(docs, length).collect()
    assert all(r["repeated"] == (r["n_removed"] > 0) for r in rows)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


def test_suffix_dedup_of_registered_length(spark, monkeypatch, tmp_path):
    """A passage that many texts share, whole copies, and a text of megabytes that repeats itself and is cut into pieces."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(90), text(1500)
    rows = [(i, f"{text(30)} {passage} {text(40)}") for i in range(60)] + [(100 + i, text(120)) for i in range(30)]
    rows += [(200, rows[65][1]), (201, rows[3][1]), (202, rows[3][1]), (203, None), (204, ""), (205, "x" * 399), (206, "y" * 400), (207, "y" * 401), (208, "ü" * 300)]
    rows += [(300, text(20_000) + long + text(9_000) + long), (301, "ab" * 30_000), (302, passage + long[:399]), (302, passage + long[:399])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from tracelake.llm.queries import QUERIES

    monkeypatch.setattr(common, "HOT", 20)
    for shard in (None, 1 << 15):
        if shard:
            monkeypatch.setattr(suffix_dedup, "SHARD", shard)
        got = QUERIES["op8_suffix_array_dedup"](spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert len(got) == len(rows) and {r[0]: tuple(r[1:]) for r in got} == removed(rows, 400)


@pytest.mark.parametrize(("length", "shard"), [(16, None), (24, 512), (20, 1000)])
def test_suffix_dedup(spark, monkeypatch, length, shard):
    if shard:  # leaders that span shards, merged by binary search
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    random.seed(3)
    base = "".join(random.choice("abcd ") for _ in range(300))
    rows = []
    for i in range(90):
        a = random.randint(0, 250)
        s = "".join(random.choice("abc d") for _ in range(random.randint(0, 80))) + base[a : a + random.randint(0, 60)] + "".join(random.choice("abcx") for _ in range(random.randint(0, 30)))
        rows.append((i, s * (1 + (i % 9 == 0))))
    rows += [(200, None), (201, ""), (202, "a" * 100), (203, rows[3][1]), (204, "é" * 60)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, spans string")
    monkeypatch.setattr(common, "HOT", 4)  # some anchors take the way of hot ones
    assert digests(docs, length) == removed(rows, length)
    assert suffix_dedup.repeat_digests(docs.limit(0), length).count() == 0


def test_suffix_array():
    random.seed(1)
    texts = ["".join(random.choice("ab") for _ in range(n)) for n in (40, 1, 60, 25)] + ["aaaaaaaaaaaa"] * 2
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    size = np.array([len(t) for t in texts])
    part, ends = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    sa = suffix_dedup.refine(data, ends, part)
    own = lambda i: bytes(data[i : ends[i]])
    assert list(sa) == sorted(range(len(data)), key=lambda i: (own(i), -part[i])) or [own(i) for i in sa] == sorted(own(i) for i in range(len(data)))
    common = suffix_dedup.kasai(data, ends, sa, 30, stretch=16)
    for k in range(1, len(sa)):
        a, b = own(sa[k - 1]), own(sa[k])
        n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
        assert common[k] == min(n, 30)


def test_winnow_covers_every_window():
    data = np.frombuffer(("".join(random.choice("abcdef") for _ in range(500)) + "z" * 60).encode(), np.uint8)
    at, _ = suffix_dedup.winnow(data, 12, 5)
    assert all(((at >= i) & (at <= i + 4)).any() for i in range(len(data) - 12 - 5 + 2))


def test_greedy_tiles():
    text, item = list("abcdefgh12345abcxyz"), list("12345abcdefgh")
    hits = [(i, j) for i in range(len(text) - 2) for j in range(len(item) - 2) if text[i : i + 3] == item[j : j + 3]]
    at, item_at = map(np.array, zip(*hits))
    tiles = tile(at, item_at, 3)
    assert tiles[0] == (8, 0, 8) and sum(n for *_, n in tiles) == 13  # the passage in another order counts in full


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    swapped = "zeta eta theta iota kappa and then alpha BETA gamma delta epsilon"
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (7, item)], "item_id long, text string")
    rows = [(1, f"x {item} y"), (2, swapped), (3, "alpha beta gamma delta something else"), (4, None), (5, ""), (None, item), (1, "clean")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, found string")
    got = sorted(((r["doc_id"], r["contaminated"], r["item_ids"], round(r["coverage"], 2)) for r in contamination(docs.drop("found"), bench).collect()), key=repr)
    assert got == sorted([(1, True, [7], 1.0), (2, True, [7], 1.0), (3, False, [], 0.0), (4, False, [], 0.0), (5, False, [], 0.0), (None, True, [7], 1.0), (1, False, [], 0.0)], key=repr)
    assert decontaminate(docs, bench).columns == docs.columns and decontaminate(docs, bench).count() == 4
    assert decontaminate(docs, bench.limit(0)).count() == 7 and decontaminate(docs.limit(0), bench).count() == 0


def brute_tiles(text, item, least):
    """Greedy string tiling by its definition: the longest common run of unmarked words, again and again."""
    used_text, used_item, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(text)):
                n = 0
                while i + n < len(item) and d + n < len(text) and item[i + n] == text[d + n] and i + n not in used_item and d + n not in used_text:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (d, i, n)
        if best is None:
            return out
        out.append(best)
        used_text.update(range(best[0], best[0] + best[2]))
        used_item.update(range(best[1], best[1] + best[2]))


@pytest.mark.parametrize("shuffled", [False, True])
def test_tiling_by_brute_force(spark, monkeypatch, shuffled):
    from tracelake.llm import decontaminate as module

    random.seed(11)
    if shuffled:  # a benchmark too large to broadcast
        monkeypatch.setattr(module, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(module, "HITS", 7)
    text = lambda n: [random.choice("abc") for _ in range(n)]
    items = [(i, " ".join(text(random.randint(0, 14)))) for i in range(8)] + [(20, "a " * 12), (20, "A a a a a b"), (None, "b b b b c c"), (21, None)]
    rows = [(i, " ".join(text(random.randint(0, 20)))) for i in range(25)] + [(90, "a " * 30), (91, None), (91, None), (None, "B b B b c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Found string")
    with pytest.raises(ValueError):
        benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string"), 3, "hits").collect()
    want = []
    for d, t in rows:
        found = []
        for i, x in items:
            words = lower(x or "").split()
            tiles = brute_tiles(lower(t or "").split(), words, 3)
            if tiles:
                found.append((str(i), len(words), sum(n for *_, n in tiles), sorted(tiles)))
        want.append((str(d), t, sorted(found)))
    have = [(str(r["doc_id"]), r["text"], sorted((str(x["item_id"]), x["n_words"], x["n_covered"], sorted(map(tuple, x["tiles"]))) for x in r["hits"])) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).columns == docs.columns


def test_words_like_the_pattern():
    text = "A b  c\x0b\x1fd é\n x\t"
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = bytesnp.spans(data, np.array([0, len(data)]))
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == WORD.findall(text)
