"""Filters, scores, mixing, shards, chat repair and token counts against brute force and on odd rows."""

import itertools
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat, common, mixing, quality, sharding, tokens, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def base_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    twice = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(twice)


ODD = [None, "", " \n\t ", "one", "a\na\na\n", "\n\na b\n a b\na b", "x " * 40, "é ü " * 9, "#*$% &|<>", "tail\n", "w1 w2 w3 w4 w5 w6 w7 w8 " * 2, "\x0b\x0cq\r\nq\r\n", "long" * 5000]


def test_text_statistics(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r[1:6]) for r in quality.text_statistics(docs, ["doc_id"]).collect()}
    assert got == {i: base_counts(t) for i, t in enumerate(ODD)}


def noisy(n, seed, junk=0.0):
    random.seed(seed)
    out = []
    for _ in range(n):
        words = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(random.randint(60, 200))]
        if random.random() < junk:
            words = [w + "###" for w in words]
        out.append(" ".join(words).capitalize() + ".")
    return out


def test_quality_keeps_clean_and_drops_junk(spark):
    clean, junk = noisy(500, 1), noisy(40, 2, 1.0)
    rows = [(i, t, "en", None) for i, t in enumerate(clean)] + [(1000 + i, t, "en", None) for i, t in enumerate(junk)] + [(2000 + i, t, None, "s") for i, t in enumerate(ODD)] + [(None, clean[0], "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("g", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["kept"] for i in range(500)) >= 498 and not any(got[1000 + i]["kept"] for i in range(40))
    for i, t in enumerate(ODD):
        n = base_counts(t)
        assert got[2000 + i]["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (got[2000 + i]["base_failed"] and got[2000 + i]["kept"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_determinant_estimate_resists_outliers(spark):
    rng = np.random.default_rng(0)
    good = rng.normal(size=(800, len(quality.FEATURES)))
    bad = rng.normal(6, 0.3, size=(150, len(quality.FEATURES)))
    rows = [(i, "g", "l", *map(float, x)) for i, x in enumerate(np.vstack([good, bad]))]
    df = spark.createDataFrame(rows, ", ".join(["i long", "g string", "l string", *(f"{c} double" for c in quality.FEATURES)]))
    d = {r["i"]: r["distance"] for r in quality.robust_distances(df).collect()}
    assert min(d[i] for i in range(800, 950)) > max(sorted(d[i] for i in range(800))[:790])
    inverse = np.linalg.inv(np.cov(good.T))
    plain = np.einsum("ij,jk,ik->i", good - good.mean(0), inverse, good - good.mean(0))
    assert np.corrcoef(plain, [d[i] for i in range(800)])[0, 1] > 0.95


def brute_verdict_inputs(groups):
    """Distances by the module's steps, in numpy with exact quantiles: {g: (l, rows)} to {g: distances}."""
    p, prior = len(quality.FEATURES), quality.PRIOR

    def shrunk(values):  # {g: (n, vector)}
        total = sum(n for n, _ in values.values())
        everything = sum(n * x for n, x in values.values()) / total
        out = {}
        for g, (n, x) in values.items():
            same = [values[h] for h in values if groups[h][0] == groups[g][0]]
            lang_n = sum(m for m, _ in same)
            lang = (sum(m * y for m, y in same) + prior * everything) / (lang_n + prior)
            out[g] = (n * x + prior * lang) / (n + prior)
        return out

    def fit(rows, floor):
        s = shrunk({g: (len(x), x.sum(0) / max(1, len(x))) for g, x in rows.items()})
        ss = shrunk({g: (len(x), x.T @ x / max(1, len(x))) for g, x in rows.items()})
        out = {}
        for g in rows:  # a group without near rows has the estimate of its language
            cov = ss[g] - np.outer(s[g], s[g])
            cov += np.diag(np.maximum(quality.FLOOR**2, 1e-3 * np.maximum(np.diag(cov), floor[g])))
            out[g] = (s[g], np.linalg.inv(cov), np.linalg.slogdet(cov)[1])
        return out

    low = lambda x, q: np.quantile(x, q, axis=0, method="inverted_cdf")
    far = lambda x, m, inv: np.einsum("ij,jk,ik->i", x - m, inv, x - m)
    rows = {g: x for g, (_, x) in groups.items()}
    mid = shrunk({g: (len(x), low(x, 0.5)) for g, x in rows.items()})
    mad = shrunk({g: (len(x), 1.4826 * low(abs(x - mid[g]), 0.5)) for g, x in rows.items()})
    floor = shrunk({g: (len(x), x.var(0, ddof=1) if len(x) > 1 else np.zeros(p)) for g, x in rows.items()})
    spread = {g: np.maximum(np.maximum(mad[g] ** 2, 1e-2 * floor[g]), quality.FLOOR**2) for g in rows}
    sd = {g: np.sqrt(spread[g]) for g in rows}
    starts = [{g: (mid[g], np.diag(1 / spread[g]), 0.0) for g in rows}, fit({g: mid[g] + 2 * sd[g] * np.tanh((x - mid[g]) / (2 * sd[g])) for g, x in rows.items()}, floor)]
    for _ in range(quality.STEPS):
        for k, now in enumerate(starts):
            d = {g: far(x, *now[g][:2]) for g, x in rows.items()}
            starts[k] = fit({g: x[d[g] <= low(d[g], quality.SUBSET)] for g, x in rows.items()}, floor)
    best = {g: min((s[g] for s in starts), key=lambda f: f[2]) for g in rows}
    half = quality.chi_square_quantile(p, 0.0)
    for last in (False, True):
        d = {g: far(x, *best[g][:2]) for g, x in rows.items()}
        by = shrunk({g: (len(x), max(low(d[g], 0.5), 1e-12) / half) for g, x in rows.items()})
        if last:
            return {g: d[g] / by[g] for g in rows}
        best = fit({g: x[d[g] <= by[g] * quality.chi_square_quantile(p, 1.96)] for g, x in rows.items()}, floor)


def test_outliers_by_brute_force(spark):
    """Groups from one row to hundreds in two languages, with junk of their own, against numpy."""
    rng = np.random.default_rng(3)
    p, groups = len(quality.FEATURES), {}
    for k, n in enumerate((1, 2, 5, 40, 300, 700)):
        x = rng.normal(k % 2, 1, size=(n, p)) @ np.diag(rng.uniform(0.5, 2, p))
        x[: n // 10] += 12
        groups[f"g{k}"] = (f"l{k % 2}", x)
    groups["junk"] = ("l0", np.full((1, p), 40.0))
    rows = [(i, g, lang, *map(float, v)) for g, (lang, x) in groups.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(["i long", "g string", "l string", *(f"{c} double" for c in quality.FEATURES)]))
    got = {(r["g"], r["i"]): r["distance"] for r in quality.robust_distances(df).collect()}
    want = brute_verdict_inputs(groups)
    assert len(got) == len(rows) and all(abs(got[g, i] - d) <= 1e-6 * max(1, d) for g, x in want.items() for i, d in enumerate(x))
    cut = quality.chi_square_quantile(p, quality.TAIL)
    assert got["junk", 0] > cut and all(got[g, i] > cut for g in ("g4", "g5") for i in range(len(groups[g][1]) // 10))


def test_mixing_meets_its_targets(spark):
    random.seed(4)
    rows = [(i, " ".join(["w"] * random.randint(1, 30)), random.choice("aab"), random.choice(["x", "y", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    table = lambda c, d: spark.createDataFrame(list(d.items()), f"{c} string, target double")
    goal = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.5, "(none)": 0.3}, "topic": {"t": 1.0}}
    targets = {c: table(c, d) for c, d in goal.items()}
    cells = mixing.with_cells(docs, F.lit("t")).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))
    fits = [mixing.rake(cells, targets)]
    held, mixing.DRIVER_CELLS = mixing.DRIVER_CELLS, 0
    try:
        fits.append(mixing.rake(cells, targets, rounds=15, tolerance=1e-7))
    finally:
        mixing.DRIVER_CELLS = held
    for fitted in fits:
        for c, d in goal.items():
            have = {r[c]: r["s"] for r in fitted.groupBy(c).agg(F.sum("fitted").alias("s")).collect()}
            assert all(abs(have[k] - v) < 1e-5 for k, v in d.items())
    drawn = mixing.draw(docs, targets, F.lit("t"))
    assert drawn.count() == 3000 and drawn.where("kept <> (copies > 0)").count() == 0
    for c in ("source", "lang"):
        have = {r[c]: r["n"] for r in drawn.groupBy(c).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
        assert all(abs(have[k] / sum(have.values()) - v) < 0.02 for k, v in goal[c].items())
    rows = drawn.collect()
    assert all(int(r["weight"]) <= r["copies"] <= int(r["weight"]) + 1 for r in rows)  # no weight is capped
    assert rows == mixing.draw(docs, targets, F.lit("t")).collect()


def test_raking_by_brute_force(spark):
    random.seed(9)
    cells = {(s, g, t): random.randint(1, 900) for s in "abc" for g in "xy" for t in "uv" if random.random() < 0.9}
    goal = {"source": dict(zip("abc", (0.2, 0.3, 0.5))), "lang": {"x": 0.4, "y": 0.6}, "topic": {"u": 0.7, "v": 0.3}}
    fitted = {k: v / sum(cells.values()) for k, v in cells.items()}
    for _ in range(300):
        for i, c in enumerate(mixing.DIMS):
            have = {}
            for k, v in fitted.items():
                have[k[i]] = have.get(k[i], 0) + v
            fitted = {k: v * goal[c][k[i]] / have[k[i]] for k, v in fitted.items()}
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    targets = {c: spark.createDataFrame(list(d.items()), f"{c} string, target double") for c, d in goal.items()}
    got = {(r["source"], r["lang"], r["topic"]): r for r in mixing.rake(table, targets).collect()}
    assert got.keys() == cells.keys()
    for k, r in got.items():
        assert abs(r["fitted"] - fitted[k]) < 1e-7 and abs(r["weight"] - fitted[k] * sum(cells.values()) / cells[k]) < 1e-5
    apart = spark.createDataFrame([("a", "x", "u", 5), ("b", "y", "u", 5)], "source string, lang string, topic string, tokens long")
    never = targets | {"lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "lang string, target double")}
    with pytest.warns(UserWarning, match="raking is off"):
        mixing.rake(apart, never)


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None), (None, "", "s", "en"), (2, "a b", "s", "en"), (2, "a b", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"topic": F.lit("clash"), "weight": F.lit(1)})
    got = mixing.draw(docs)
    assert got.count() == 4 and got.where("n_tokens = 0").where("copies = 1").count() == 2
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.draw(docs.limit(0)).count() == 0


def brute_runs(shards, target):
    """Rewrites of a list of (shard, bytes, tier): by tier in order of size, a new run at each multiple of the target."""
    out = []
    for level in sorted({t for *_, t in shards}):
        held, runs_ = 0, {}
        for b, name in sorted((b, name) for name, b, t in shards if t == level and 2 * b < target):
            runs_.setdefault(held // target, []).append(name)
            held += b
        out += [(sorted(names), 1) for names in runs_.values() if len(names) > 1]
    return sorted(out + [([name], -(-b // target)) for name, b, _ in shards if b > 2 * target])


def test_runs_fill_the_target(spark):
    random.seed(2)
    rows = [(f"s{i}", 1, b, t) for i, (b, t) in enumerate([(10, 0)] * 9 + [(45, 1), (46, 1), (99, 1), (450, 2)] + [(random.randint(1, 120), i % 3) for i in range(60)])]
    got = {}
    for r in sharding.runs(spark.createDataFrame(rows, sharding.MANIFEST), target=100).collect():
        got.setdefault((r["run"], r["files"]), []).append(r["shard"])
    assert sorted((sorted(v), k[1]) for k, v in got.items()) == brute_runs([(n, b, t) for n, _, b, t in rows], 100)


def test_shards(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    make = lambda a, b: spark.range(a, b).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    assert sharding.append(make(0, 400).repartition(6), root) == 1
    assert sharding.append(make(400, 500).repartition(4), root, most=10) == 2
    before = sharding.manifest(spark, root, 2)
    assert before.count() >= 16 and before.where("rows > 10").count() == 6
    plan = brute_runs([(r["shard"], r["bytes"], r["tier"]) for r in before.collect()], 40_000)
    assert sharding.compact(spark, root, target=40_000) == 3
    merged = sharding.manifest(spark, root, 3)
    assert merged.count() == before.count() - sum(len(names) for names, _ in plan) + sum(n for _, n in plan)
    assert merged.agg(F.sum("rows")).first()[0] == 500
    for version, n in ((1, 400), (2, 500), (3, 500)):
        rows = sharding.read(spark, root, version)
        assert rows.drop("shard").exceptAll(make(0, n)).count() == 0 and rows.count() == n
    joined = sharding.read(spark, root).groupBy("shard").count().join(merged, "shard").where("count = rows").count()
    assert joined == merged.count()
    assert sharding.compact(spark, root, target=2000) == 4 and sharding.manifest(spark, root, 4).count() > merged.count()  # large ones are cut
    assert sharding.vacuum(spark, root) >= 2 and sharding.versions(spark, root) == [4]
    assert sharding.read(spark, root).drop("shard").exceptAll(make(0, 500)).count() == 0 and sharding.read(spark, root).count() == 500


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/data"
    docs = spark.range(20).withColumnRenamed("id", "doc_id")
    sharding.append(docs, root)
    shards, schema = sharding.manifest(spark, root, 1), sharding.schema_of(spark, root, 1)
    assert sharding._commit(spark, root, shards, 2, schema) == 2
    held = sharding._version(spark, root, 2)
    with pytest.raises(sharding.Conflict):
        sharding._commit(spark, root, shards.limit(0), 2, schema)
    assert sharding._version(spark, root, 2) == held and sharding.versions(spark, root) == [1, 2]
    assert sharding.read(spark, root).count() == 20

    def append(k):
        try:
            return sharding.append(docs.withColumn("doc_id", F.col("doc_id") + 100 * k), root)
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = [v for v in pool.map(append, range(1, 5)) if v]
    assert len(done) == len(set(done)) and sharding.read(spark, root).count() == 20 * (1 + len(done))


def test_shards_keep_any_columns(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), *(F.concat(F.lit(c), "id").alias(c) for c in ("shard", "_shard", "Run", "run_", "_rows", "_files", "bytes", "a.b", "tier", "_metadata")))
    docs = docs.union(docs.limit(3)).union(docs.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes)))
    placed = sharding.shard_documents(docs, f"file://{tmp_path}/own")
    assert placed.columns == ["doc_id", "shard", "shard_tier", "shard_rows", "shard_bytes", "version"] and placed.count() == 54
    stored = sharding.read(spark, f"file://{tmp_path}/own")
    assert stored.columns == [*docs.columns, "__shard"]
    assert stored.drop("__shard").exceptAll(docs).count() == 0 and docs.exceptAll(stored.drop("__shard")).count() == 0
    more = spark.createDataFrame([(900, "new", "v")], "doc_id long, extra string, SHARD string")
    sharding.append(more, f"file://{tmp_path}/own")
    sharding.compact(spark, f"file://{tmp_path}/own")
    sharding.vacuum(spark, f"file://{tmp_path}/own")
    rows = sharding.read(spark, f"file://{tmp_path}/own")
    assert rows.count() == 55 and rows.where("extra is not null").select("doc_id", "extra", "shard", "Run").collect() == [(900, "new", "v", None)]
    with pytest.raises(ValueError):
        sharding.append(spark.createDataFrame([(1, 2)], "doc_id long, extra long"), f"file://{tmp_path}/own")
    assert sharding.shard_documents(docs.limit(0), f"file://{tmp_path}/none").count() == 0
    assert sharding.read(spark, f"file://{tmp_path}/none").count() == 0


def brute_rule(host, path):
    best = None
    for rule in url_filter.RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best)):
            best = rule
    return best


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q=1#f", "x://net", "x://net/", "x://planet/", "https://a.example.com/de/1", "https://a.example.com/DE/1", "http://b.org/fr/", "http://b.org/fr", "http://h://i/j", "a\nb://c.net/d"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[4], "c")], "page_id long, url string, template string")
    labels = spark.createDataFrame([], "page_id long, good int")
    got = url_filter.filter_urls(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        if r["page_id"] is None:
            continue
        url = URLS[r["page_id"]] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (url_filter.RULES[rule] if rule else "allow")
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0


def brute_templates(shapes):
    """{(host, path): template} of {(host, path): (n, labelled, good)}, by walking each host's tree from the top."""
    out = {}

    def walk(node, held, level):
        total = sum(v[0] for _, v in held)
        rests = {tuple(parts[level:]) for (_, parts, _), _ in held}
        if len(rests) == 1 or total < url_filter.SPLIT:
            for (host, parts, path), _ in held:
                tail = list(parts[level:]) if len(rests) == 1 else ["**"] if len(parts) > level else []
                out[host, path] = "/" + "/".join(node + tail)
            return
        children = {}
        for key, v in held:
            if len(key[1]) <= level:
                out[key[0], key[2]] = "/" + "/".join(node)
            else:
                children.setdefault(key[1][level], []).append((key, v))
        counts = {c: [sum(v[i] for _, v in x) for i in range(3)] for c, x in children.items()}
        n, labelled, good = (sum(v[i] for v in counts.values()) for i in range(3))
        branches = {}
        for c, x in children.items():
            cn, cl, cg = counts[c]
            rare = len(children) >= 16 and len(children) > 0.5 * n and cn < 0.05 * n
            alike = len(children) > 1 and 0 < cl < labelled and abs(cg / cl - good / labelled) <= 1.96 * (good / labelled * (1 - good / labelled) / cl) ** 0.5
            branches.setdefault("*" if rare or alike else c, []).extend(x)
        for c, x in branches.items():
            walk([*node, c], x, level + 1)

    for host in {h for h, _ in shapes}:
        walk([], [((h, [s for s in p.split("/") if s], p), v) for (h, p), v in shapes.items() if h == host], 0)
    return out


def test_url_templates(spark):
    random.seed(2)
    rows = [(i, f"http://h.io/{'spam' if i % 2 else 'news'}/{random.choice('abcdefgh') * random.randint(3, 9)}{i}/p") for i in range(400)]
    rows += [(1000 + i, f"http://u.io/{''.join(random.choice('abcdefghijk') for _ in range(9))}/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.where("page_id < 200").selectExpr("page_id", "int(page_id % 2 = 0) as good")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels, {}).collect()}
    assert {got[i]["template"] for i in range(400)} == {"/news/*/p", "/spam/*/p"}
    assert all(got[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(400))
    assert {got[1000 + i]["template"] for i in range(60)} == {"/*/x"}


@pytest.mark.parametrize("hot", [False, True])
def test_url_verdicts_by_brute_force(spark, monkeypatch, hot):
    random.seed(12)
    if hot:  # nodes, segments, templates and urls with several rows take the way of hot ones, and shapes are not broadcast
        monkeypatch.setattr(common, "HOT", 3)
        monkeypatch.setattr(url_filter, "BROADCAST_SHAPES", 0)
    rows = []
    for i in range(1500):
        parts = [random.choice(["en", "fr", "de", "x"]), random.choice(["a", "b", "spam"]), *(str(random.randint(1, 900)) for _ in range(random.randint(0, 3)))][: random.randint(0, 5)]
        rows.append((i, f"http://{random.choice(['p.io', 'q.io', 'r.io'])}/{'/'.join(parts)}", random.choice([None, None, 0 if "spam" in parts else 1, random.randint(0, 1)])))
    deep = "/".join("abcdefghijkl")
    rows += [(2000 + i, f"http://deep.io/{deep}/{i % 2}/t", i % 2) for i in range(40)] + [(None, "http://deep.io/", None), (3000, None, 1), (3000, "http://p.io/" + "y" * 5000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good int").withColumns({"template": F.lit("clash"), "Host": F.lit("clash")})
    marks = {}
    for i, _, g in rows:
        if i is not None and g is not None:
            marks[i] = min(g, marks.get(i, 1))
    split = lambda u: re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "").groups() if u else ("", "")
    shapes = {}
    for i, u, _ in rows:
        v = shapes.setdefault(split(u), [0, 0, 0])
        v[0] += 1
        v[1] += i in marks
        v[2] += marks.get(i, 0)
    named = brute_templates(shapes)
    sums = {}
    for key, v in shapes.items():
        for k in ((key[0], named[key]), (key[0], None), None):
            sums[k] = [a + b for a, b in zip(sums.get(k, [0, 0, 0]), v)]
    base = sums[None][2] / sums[None][1]

    def purity(host, name):
        of_host = (sums[host, None][2] + 8 * base) / (sums[host, None][1] + 8)
        return (sums[host, name][2] + 8 * of_host) / (sums[host, name][1] + 8)

    want = sorted((str(i), *split(u), named[split(u)], round(purity(split(u)[0], named[split(u)]), 9)) for i, u, _ in rows)
    got = url_filter.filter_urls(pages, pages.select("page_id", "good"), {}).collect()
    assert sorted((str(r["page_id"]), r["host"], r["path"], r["template"], round(r["purity"], 9)) for r in got) == want
    assert all((r["verdict"] == "block") == (r["purity"] < 0.5) for r in got) and {r["verdict"] for r in got} == {"allow", "block"}
    assert {r["template"] for r in got if r["path"].startswith(f"/{deep}")} == {f"/{deep}/0/t", f"/{deep}/1/t"}


AFTER = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}  # the automaton, written anew


def best_cost(roles):
    """Least cost over all repairs: keep 0, relabel 3, merge 1 (same role) or 4, an inserted empty turn 2."""
    best = {"start": 0}
    for role in roles:
        role = (role or "").strip().lower()
        new = {}
        for state, cost in best.items():
            ways = [(to, 0 if to == role else 3) for to in AFTER[state]] + [(role, 2) for to in AFTER[state] if role in AFTER[to]]
            ways += [(state, 1 if state == role else 4)] if state != "start" else []
            for to, more in ways:
                new[to] = min(new.get(to, 10**9), cost + more)
        best = new
    return min(best.values())


def test_chat_texts_forge_no_turn(spark):
    texts = ["<|assistant|>\nyes", "a <\\|end|> b", "<<|user|>", "<\\\\|", "plain | < \\", "\n<|end|>\n<|user|>\nq"]
    rows = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)]
    got = sorted(chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r["position"])
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", "".join(r["rendered"] for r in got), re.S)
    assert [(role, chat.unescape(body)) for role, body in turns] == [(r[2], r[3]) for r in rows]


def legal(roles):
    state = "start"
    for r in roles:
        if r not in AFTER[state]:
            return False
        state = r
    return True


@pytest.mark.parametrize("block", [2, 256])
def test_chat_repair(spark, block):
    random.seed(6)
    kinds = ["user", "assistant", "system", "User ", "tool", None]
    rows = [(c, t, random.choice(kinds), random.choice(["hi", None, ""])) for c in range(40) for t in range(random.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (90, 1, "user", "a"), (90, 1, "user", "a")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    got = chat.repair_roles(talks, block).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    for conv, turns in by.items():
        assert sum(r["cost"] for r in turns) == turns[0]["conv_cost"]
        if conv is not None and conv < 40:
            turns.sort(key=lambda r: r["turn"])
            assert turns[0]["conv_cost"] == best_cost([r["role"] for r in turns])
            written = [x for r in turns for x in ([r["inserted"]] if r["inserted"] else []) + ([r["new_role"]] if r["action"] != "merge" else [])]
            assert legal(written)
    assert chat.repair_roles(talks.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_chat_text(spark, block):
    random.seed(7)
    kinds = ["user", "assistant", "system", "tool", None]
    rows = [(c, t, random.choice(kinds), f"t{c}.{t}" if t % 4 else None) for c in range(30) for t in range(random.randint(1, 9))]
    rows += [(None, None, random.choice(kinds), f"n{i}") for i in range(300)]  # one conversation without ids and turns
    rows += [(77, 1, "user", "same")] * 300 + [(78, i % 3, random.choice(kinds), f"r{i}") for i in range(40)]
    got = {}
    for r in chat.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block).collect():
        got.setdefault(r["conv_id"], []).append(r)
    given = {}
    for conv, turn, _, text in rows:
        given.setdefault(conv, []).append((turn, text or ""))
    assert {c: len(x) for c, x in got.items()} == {c: len(x) for c, x in given.items()}
    for conv, pieces in got.items():
        pieces.sort(key=lambda r: r["position"])
        assert [r["position"] for r in pieces] == list(range(len(pieces)))
        assert [r["turn"] for r in pieces] == sorted((t for t, _ in given[conv]), key=lambda t: -1 if t is None else t)
        assert pieces[0]["conv_cost"] == sum(r["cost"] for r in pieces) == best_cost([r["role"] for r in pieces])
        text = "".join(r["rendered"] for r in pieces)
        turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", text, re.S)
        assert "".join(f"<|{role}|>\n{body}\n<|end|>\n" for role, body in turns) == text and legal([role for role, _ in turns])
        want = []
        for r in pieces:
            want += [[r["inserted"], None]] if r["inserted"] else []
            want += [[r["new_role"], []]] if r["action"] != "merge" else []
            want[-1][1].append(r)
        by_turn = [(role, 1 if held is None else len(held)) for role, held in want]
        assert [(role, 1 if body == "" else body.count("\n") + 1) for role, body in turns] == by_turn
        bodies = [x for (_, body), (_, held) in zip(turns, want) if held is not None for x in body.split("\n")]
        assert sorted(bodies) == sorted(t for _, t in given[conv])


def test_chat_blocks_are_cut_by_rank(spark):
    rows = [(None, None, "user", f"n{i}") for i in range(500)] + [(1, 1, "user", "same")] * 500 + [(2, t, "user", "x") for t in range(40)]
    keyed = spark.createDataFrame([(*r, hash(r[3])) for r in rows], "conv long, turn long, role string, text string, place long").fillna({"turn": chat.NO_TURN})
    sizes = chat.blocks(keyed, 8).groupBy(*chat.KEY).count()
    assert sizes.agg(F.max("count")).first()[0] == 8 and sizes.agg(F.sum("count")).first()[0] == len(rows)


def test_matrices_equal_paths():
    for roles in itertools.product([*chat.ROLES, None], repeat=3):
        m = chat.STEP[roles[0]]
        for r in roles[1:]:
            m = chat.compose(m, chat.STEP[r])
        assert m[0].min() == chat.path(list(roles), 0)[0] == best_cost(roles)


def test_token_counts(spark):
    texts = ["Hello world\nsecond line\n", None, "", "\n\n", "naïve café\nx", "no break", "a\r\n b"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    encoding, _ = tokens._encoding(VOCABULARY)
    for rule in tokens.RULES:
        for r in tokens.token_counts(docs, VOCABULARY, rule).collect():
            text = texts[r["doc_id"]] or ""
            ids = encoding.encode_ordinary(text)
            assert r["n_tokens"] == len(ids) == round(sum(r["section_tokens"]), 6)
            assert r["n_sections"] == len(text.splitlines(keepends=True) if "\r" not in text else text.split("\n"))
            if rule == "start":
                want, at = [0] * r["n_sections"], 0
                for piece in map(encoding.decode_single_token_bytes, ids):
                    want[text.encode()[:at].count(b"\n")] += 1
                    at += len(piece)
                assert r["section_tokens"] == want
    assert tokens.token_counts(docs.limit(0), VOCABULARY).count() == 0
    assert tokens.attribute(np.array([4]), np.array([0, 1, 4]), "most")[0].tolist() == [0, 1]
    assert tokens.attribute(np.array([4]), np.array([0, 1, 4]), "split")[0].tolist() == [0.25, 0.75]


def brute_attribution(pieces, borders, rule):
    """Tokens (byte strings, in order) to sections, byte by byte."""
    out, at = [0.0] * (len(borders) - 1), 0
    section = lambda byte: max(i for i in range(len(out)) if borders[i] <= byte < borders[i + 1])
    for piece in pieces:
        held = {}
        for byte in range(at, at + len(piece)):
            held[section(byte)] = held.get(section(byte), 0) + 1
        if rule == "start":
            out[section(at)] += 1
        elif rule == "most":
            out[min(held, key=lambda i: (-held[i], i))] += 1
        else:
            for i, n in held.items():
                out[i] += n / len(piece)
        at += len(piece)
    return out


def test_token_attribution_by_brute_force(spark):
    rows = [(1, "Title  ", "body\n\n  text", "é"), (2, None, "", None), (3, "", "x", "\n\n"), (3, "", "x", "\n\n"), (None, "a" * 5000, "   ", "  b\t\t c"), (4, " ", " ", " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `b.c` string, sizes string")
    encoding, _ = tokens._encoding(VOCABULARY)
    for fields in ((), ("text", "b.c", "sizes")):
        for rule in tokens.RULES:
            got = tokens.token_counts(docs, VOCABULARY, rule, fields).collect()
            want = []
            for d, *values in rows:
                parts = [v or "" for v in values] if fields else [values[0] or ""]
                text = "\n".join(parts)
                if fields:
                    sizes = [len((v + ("\n" if i < len(parts) - 1 else "")).encode()) for i, v in enumerate(parts)]
                else:
                    sizes = [len(v.encode()) for v in re.findall(r"[^\n]*\n|[^\n]+", text)]
                pieces = [encoding.decode_single_token_bytes(t) for t in encoding.encode_ordinary(text)]
                want.append((d, len(pieces), len(sizes), [round(x, 9) for x in brute_attribution(pieces, [sum(sizes[:i]) for i in range(len(sizes) + 1)], rule)]))
            assert sorted(((r["doc_id"], r["n_tokens"], r["n_sections"], [round(x, 9) for x in r["section_tokens"]]) for r in got), key=repr) == sorted(want, key=repr)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.score_toxicity(docs, labels, rounds=10).join(labels, "doc_id", "left").collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scores)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scores)
    test = [r for r in scores if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in test) / len(test) > 0.85


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "you idiot"), (2, ""), (2, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, none)
    assert got.count() == 4 and got.where("score = 0").count() == 4
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
