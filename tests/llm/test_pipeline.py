"""The corpus pipeline: each stage on its own input against a brute-force version, and odd tables."""

import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_pairs import brute_tiles, components, lower
from test_rows import base_counts, brute_verdict_inputs

from tracelake.llm import mixing, quality

STAGES = dict(corpus_pipeline.STAGES)


def corpus(spark, folder):
    random.seed(21)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(14))) for i in range(4)] + [(9, "too short"), (10, None)]
    rows = []
    for i in range(160):
        words = text(random.randint(40, 120))
        if i % 11 == 0:
            words[10:10] = items[i % 4][1].capitalize().split()
        if i % 13 == 0:
            words = [w + "###" for w in words]
        if i % 17 == 0:
            words = words[:15]
        rows.append((i, " ".join(words), random.choice(["en", "fr"]), random.choice(["s", "s", "s", "t", None])))
    rows += [(200 + i, rows[i][1], "en", "s") for i in range(20)] + [(300 + i, rows[i][1] + " tail", None, "t") for i in range(20, 30)]
    rows += [rows[3], (None, rows[4][1], "en", "s"), (None, None, None, None), (400, None, "en", "s"), (401, "", "fr", "t")]
    rows = [(*r, len(r[1] or ""), "clash") for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, Found string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def good(spark, docs):
    """doc_ids that the quality rules reject."""
    pairs = quality._features(quality.text_statistics(docs, ["doc_id", "lang", "source"])).collect()
    groups, ids, bad = {}, {}, set()
    for r in pairs:
        if r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]:
            bad.add(r["doc_id"])
            continue
        key = (r["lang"], r["source"])
        groups.setdefault(key, []).append([r[c] for c in quality.FEATURES])
        ids.setdefault(key, []).append(r["doc_id"])
    far = brute_verdict_inputs({g: (g[0], np.array(x)) for g, x in groups.items()})
    cut = quality.chi_square_quantile(len(quality.FEATURES), quality.TAIL)
    return bad | {d for g, x in far.items() for d, y in zip(ids[g], x) if y > cut}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_stage_by_brute_force(spark, tmp_path):
    rows, items = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns

    out = STAGES["quality_rules"](spark, docs, str(tmp_path)).cache()
    bad = good(spark, docs)
    assert out.columns == columns and rows_of(out) == sorted([r for r in rows if r[0] is None or r[0] not in bad], key=repr)
    assert all(base_counts(r[1])[0] >= 20 for r in rows_of(out) if r[0] is not None) and any(0 < len(r[1] or "") and "###" in r[1] for r in rows if r[0] in bad)

    docs, held = out, rows_of(out)
    out = STAGES["ngram_jaccard_join"](spark, docs, str(tmp_path)).cache()
    head = {d: h for d, (_, h) in components([r[:2] for r in held if r[0] is not None]).items()}
    want = sorted({r for r in held if r[0] is not None and head[r[0]] == r[0]}, key=repr) + [r for r in held if r[0] is None]
    assert out.columns == columns and rows_of(out) == sorted(want, key=repr) and len(want) < len(held)

    docs, held = out, rows_of(out)
    out = STAGES["benchmark_decontamination"](spark, docs, str(tmp_path)).cache()
    covers = lambda text: any(2 * sum(n for *_, n in brute_tiles(lower(text or "").split(), lower(x).split(), 5)) >= len(x.split()) for _, x in items[:4])
    want = [r for r in held if not covers(r[1])]
    assert out.columns == columns and rows_of(out) == sorted(want, key=repr) and len(want) < len(held)

    docs, held = out, rows_of(out)
    out = STAGES["mixing"](spark, docs, str(tmp_path)).cache()
    cells = mixing.with_cells(docs).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 11) / float(1 << 53)).collect()
    tokens = {}
    for r in cells:
        key = (r["source"], r["lang"], r["topic"])
        tokens[key] = tokens.get(key, 0) + r["n_tokens"]
    total, fitted = sum(tokens.values()), {k: v / sum(tokens.values()) for k, v in tokens.items() if v}
    goal = []
    for i in range(3):
        sums = {v: sum(t for k, t in tokens.items() if k[i] == v) ** mixing.TEMPERATURE for v in {k[i] for k in fitted}}
        goal.append({v: x / sum(sums.values()) for v, x in sums.items()})
    for _ in range(200):
        off = 0.0
        for i in range(3):
            have = {v: sum(f for k, f in fitted.items() if k[i] == v) for v in goal[i]}
            off = max(off, *(abs(have[v] - goal[i][v]) for v in goal[i]))
            fitted = {k: f * goal[i][k[i]] / have[k[i]] for k, f in fitted.items()}
        if off < 1e-9:
            break
    copies = {}
    for r in cells:
        key = (r["source"], r["lang"], r["topic"])
        weight = fitted[key] / (tokens[key] / total) if r["n_tokens"] else 1.0
        copies[r["doc_id"]] = math.floor(weight + r["u"])
    assert out.columns == columns and rows_of(out) == sorted([r for r in held for _ in range(copies[r[0]])], key=repr)

    placed = STAGES["sharding"](spark, out, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or -1 for r in placed) == sorted(r[0] or -1 for r in rows_of(out))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or -1 for r in whole) == sorted(r["doc_id"] or -1 for r in placed)


def test_empty_corpus(spark, tmp_path):
    rows, _ = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]


def test_quality_rules_plans_few_broadcasts(spark):
    """The driver holds every broadcast of a session in pages of some MB, and every plan, until its garbage goes."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsCount()
    docs = spark.read.parquet(f"/root/testdata/sf0.001/documents.parquet")
    assert corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.001").count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = Counter()
    for i in range(seen, store.executionsCount()):
        nodes = store.planGraph(store.executionsList().apply(i).executionId()).allNodes()
        found.update(nodes.apply(k).name() for k in range(nodes.size()))
    assert 0 < found["BroadcastExchange"] <= 24 and found["SortMergeJoin"] <= 4 and found["Exchange"] <= 60, found
