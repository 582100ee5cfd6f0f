"""Quality rules: plain limits first, then robust multivariate outliers of each language and source.

Statistics of a text become a vector of transformed ratios. The minimum-covariance-determinant estimate of each group of one
language and source is found by concentration steps from two deterministic starts: distances, the group's quantile of them (a
mergeable sketch), and the mean and covariance of the nearest part. Every step is two aggregations with partial sums, so a group
that holds a third of the rows costs no task more. A reweighted estimate gives the distances that decide.

What is estimated of a group is shrunk towards its language, and that towards all: the estimate above counts as much as PRIOR rows.
So each group has its own estimate whatever its size, a small one leans on its language, and no group is pooled or let pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import bytesnp
from tracelake.llm.common import stage_table

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits", "n_points", "n_bytes", "n_distinct", "n_lines"]
FEATURES = ["f_word", "f_caps", "f_points", "f_odd", "f_distinct"]
PRIOR = 200.0  # rows that the estimate of the language (or of all languages) counts for in that of a group (or a language)
SKETCH = 5_000  # accuracy of quantiles: ranks are right to one part in so many
SUBSET = 0.75
STEPS = 4
TAIL = 8.0  # standard normal quantile of the cutoff
FLOOR = 0.02  # least standard deviation of a feature: near-constant ones decide nothing on their own
SHRINK = 200.0  # words at which a ratio counts half
BROADCAST_GROUPS = 5_000
BROADCAST_IDS = 1_000_000  # 8 MB of ids; beyond, a shuffled join
REPEAT = 8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_POINT = np.isin(np.arange(256), list(b".,;:!?'\"-()"))


def _sums(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts of STATS, a row for each row; a null text has no words and no lines."""

    def measure(batches):
        for batch in batches:
            for at, to, data, offs in bytesnp.pieces(batch.column("text")):
                n = to - at
                s, e, row = bytesnp.spans(data, offs)
                first = np.searchsorted(row, np.arange(n + 1))
                word = np.zeros(len(data) + 1, np.int64)
                np.add.at(word, s, 1)
                np.add.at(word, e, -1)
                word = np.cumsum(word)[:-1] > 0
                h = bytesnp.word_hashes(data, s, e, lower=False)
                # equal windows of one text: the hash is tied to the row
                runs = bytesnp.windows(h, REPEAT)
                own = np.flatnonzero(row[: len(runs)] == row[REPEAT - 1 :]) if len(runs) else np.zeros(0, np.int64)
                cover = np.zeros(len(h) + 1, np.int64)
                if len(own):
                    key = bytesnp.mix(runs[own] + row[own].astype(np.uint64) * bytesnp.U(0x9E3779B97F4A7C15))
                    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
                    again = own[count[inverse] > 1]
                    np.add.at(cover, again, 1)
                    np.add.at(cover, again + REPEAT, -1)
                repeated = np.cumsum(cover)[:-1] > 0
                # lines: equal to an earlier one of the same text
                breaks = np.flatnonzero(data == 10)
                ls = np.sort(np.concatenate([offs[:-1], breaks + 1]))
                lrow = np.searchsorted(offs, ls, "right") - 1
                # an empty text, or a break that ends a text, begins no line with a word
                le = np.empty(len(ls), np.int64)
                le[:-1], le[-1:] = ls[1:], len(data)
                le = np.minimum(le, offs[np.minimum(lrow + 1, n)])
                ended = (le > ls) & (data[np.maximum(le - 1, 0)] == 10) if len(data) else np.zeros(len(ls), bool)
                le = np.where(ended, le - 1, le)
                held = np.concatenate([[0], np.cumsum(word)])
                full = np.flatnonzero(held[le] > held[ls])
                dup = np.zeros(n, np.int64)
                if len(full):
                    c = bytesnp.prefix_hashes(data)
                    text = bytesnp.mix((c[le[full]] - c[ls[full]]) * bytesnp.powers(len(data))[1][ls[full]] + (le - ls)[full].astype(np.uint64))
                    key = bytesnp.mix(text + lrow[full].astype(np.uint64) * bytesnp.U(0x9E3779B97F4A7C15))
                    firsts = np.unique(key, return_index=True)[1]
                    later = np.ones(len(full), bool)
                    later[firsts] = False
                    dup = np.bincount(lrow[full][later], minlength=n)
                pair = row[np.unique(bytesnp.mix(h + row.astype(np.uint64) * bytesnp.U(0x9E3779B97F4A7C15)), return_index=True)[1]]
                cols = [
                    np.diff(first),
                    _sums(word & ((data & 0xC0) != 0x80), offs),
                    _sums(_SYMBOL[data], offs),
                    dup,
                    np.diff(np.concatenate([[0], np.cumsum(repeated)])[first]),
                    _sums((data >= 65) & (data <= 90), offs),
                    _sums((data >= 48) & (data <= 57), offs),
                    _sums(_POINT[data], offs),
                    np.diff(offs),
                    np.bincount(pair, minlength=n),
                    np.bincount(lrow[full], minlength=n) if len(full) else np.zeros(n, np.int64),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at:to] for c in keep), *(pa.array(c.astype(np.int64)) for c in cols)], names=[*keep, *STATS])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(measure, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in STATS)]))


def base_failed(min_words: int = 20, most_repeated: int = 30):
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def _features(stats: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    size = F.greatest(F.col("n_bytes"), F.lit(1)).cast("double")
    trust = F.sqrt(words / (words + SHRINK))

    def share(count, of):
        return F.asin(F.sqrt(F.least(F.lit(1.0), (count + 0.5) / (of + 1.0)))) * trust

    return stats.withColumns({
        "f_word": F.log1p(F.col("word_chars") / words) * trust,
        "f_caps": share(F.col("n_capitals"), size),
        "f_points": share(F.col("n_points"), size),
        "f_odd": share(F.col("n_symbols"), size),
        "f_distinct": F.log1p(F.col("n_distinct")) / F.log1p(words) * trust,
    })


def _shrunk(groups: DataFrame, columns: list[str]) -> DataFrame:
    """``groups(g, l, start, n, *columns, ...)`` with the columns, arrays of means over n rows, shrunk to those of l and of all.

    A row for each group and start, so a small table: the sums are windows over it, which plan as one shuffle and no join.
    """
    size = len(FEATURES) * (len(FEATURES) + 1) // 2

    def over(keys: list[str], level: str) -> dict:
        part = Window.partitionBy(*keys)
        sums = {f"{level}_{c}": F.array(*(F.sum(F.get(c, F.lit(i)) * F.col("n")).over(part) for i in range(size))) for c in columns}
        return {f"{level}_n": F.sum("n").over(part)} | sums

    summed = groups.withColumns(over(["l", "start"], "l") | over(["start"], "a"))
    out = {c: F.expr(f"transform({c}, (x, i) -> (n * x + {PRIOR}D * (l_{c}[i] + {PRIOR}D * a_{c}[i] / a_n) / (l_n + {PRIOR}D)) / (n + {PRIOR}D))") for c in columns}
    return summed.select(*(out.get(c, F.col(c)).alias(c) for c in groups.columns))


def _solve(frames):
    """Mean and inverse covariance of each group from its first and second moments; directions without spread get a small floor."""
    p = len(FEATURES)
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            mean = np.array(r.s)
            cov = np.zeros((p, p))
            cov[np.triu_indices(p)] = np.array(r.ss)
            cov = np.triu(cov) + np.triu(cov, 1).T - np.outer(mean, mean)
            cov += np.diag(np.maximum(FLOOR**2, 1e-3 * np.maximum(np.diag(cov), np.array(r.floor))))
            sign, det = np.linalg.slogdet(cov)
            out.append((r.g, r.start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(det), r.floor))
        yield pd.DataFrame(out, columns=["g", "start", "mean", "inv", "det", "floor"])


def _moments(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The estimate of each group and start from ``rows(g, l, start, floor, *FEATURES)``.

    A group of ``groups(g, l, floor)`` without rows has the estimate of its language.
    """
    p = range(len(FEATURES))
    sums = rows.groupBy("g", "l", "start").agg(F.count("*").alias("n"), F.array(*(F.avg(FEATURES[i]) for i in p)).alias("s"), F.array(*(F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i in p for j in p if i <= j)).alias("ss"), F.array(*(F.max(F.col("floor")[i]) for i in p)).alias("floor"))
    if groups is not None:
        nothing = lambda k: F.array_repeat(F.lit(0.0), k)
        whole = {"start": F.lit(0), "n": F.lit(0), "s": nothing(len(p)), "ss": nothing(len(p) * (len(p) + 1) // 2)}
        sums = groups.join(sums.drop("l", "floor").hint("merge"), "g", "left").select("g", "l", "floor", *(F.coalesce(F.col(c), x).alias(c) for c, x in whole.items()))
    return stage_table(_shrunk(sums, ["s", "ss"]).mapInPandas(_solve, "g string, start int, mean array<double>, inv array<double>, det double, floor array<double>"), "moments")


def _distance():
    """Squared Mahalanobis distance, as one expression over the columns mean and inv."""
    p = range(len(FEATURES))
    d = [F.col(FEATURES[i]) - F.col("mean")[i] for i in p]
    return sum((d[i] * d[j] * F.col("inv")[i * len(FEATURES) + j] for i in p for j in p), F.lit(0.0))


def chi_square_quantile(p: int, z: float) -> float:
    """Wilson and Hilferty's approximation at the normal quantile z."""
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


def robust_distances(rows: DataFrame) -> DataFrame:
    """Add ``distance`` (squared, scaled so that a large group's median is that of chi-square) to rows with FEATURES, ``g`` and ``l``.

    ``g`` is a group and ``l`` the language that it belongs to. A group of equal rows has distances near 0; an empty table gives
    no rows.
    """
    p = len(FEATURES)
    # a language or source column can hold anything: the number of groups is checked before a table of them is broadcast
    few = rows.select("g").distinct().count() <= BROADCAST_GROUPS
    met = lambda groups: F.broadcast(groups) if few else groups
    quantile = lambda c, q: F.percentile_approx(c, q, SKETCH)
    one = F.lit(0).alias("start")
    # each table of groups carries on what later steps need of the one before, so that rows meet one table a step: the driver holds a
    # broadcast, however small, in pages of some MB until it happens to collect its garbage
    carried = lambda *columns: [F.first(c).alias(c) for c in columns]
    mid = rows.groupBy("g", "l", one).agg(F.count("*").alias("n"), F.array(*(quantile(c, 0.5) for c in FEATURES)).alias("mid"))
    mid = stage_table(_shrunk(mid, ["mid"]).select("g", "mid"), "medians")
    dev = rows.join(met(mid), "g").groupBy("g", "l", one).agg(F.count("*").alias("n"), F.array(*(quantile(F.abs(F.col(c) - F.col("mid")[i]), 0.5) * 1.4826 for i, c in enumerate(FEATURES))).alias("mad"), F.array(*(F.coalesce(F.var_samp(c), F.lit(0.0)) for c in FEATURES)).alias("floor"), *carried("mid"))
    scale = stage_table(_shrunk(dev, ["mad", "floor"]).select("g", "l", "mid", "mad", "floor"), "scales")
    groups = scale.select("g", "l", "floor")
    scale = scale.drop("l")
    spread = f"transform(mad, (m, i) -> greatest(m * m, 1e-2 * floor[i], {FLOOR**2}D))"
    flat = ", ".join(f"if({i} = {j}, 1.0 / x[{i}], 0.0)" for i in range(p) for j in range(p))
    plain = scale.selectExpr("g", "0 as start", "mid as mean", f"transform(array({spread}), x -> array({flat}))[0] as inv", "0.0D as det", "floor")
    # the second start: moments of rows pulled in by tanh, scaled back
    pulled = rows.join(met(scale.withColumn("sd", F.expr(f"transform({spread}, v -> sqrt(v))"))), "g")
    pulled = pulled.select("g", "l", F.lit(1).alias("start"), "floor", *((F.col("mid")[i] + F.col("sd")[i] * F.tanh((F.col(c) - F.col("mid")[i]) / (2 * F.col("sd")[i])) * 2).alias(c) for i, c in enumerate(FEATURES)))
    fits = plain.unionByName(_moments(pulled))
    for _ in range(STEPS):
        far = rows.join(met(fits), "g").withColumn("d", _distance())
        cut = stage_table(far.groupBy("g", "start").agg(quantile("d", SUBSET).alias("cut"), *carried("mean", "inv", "floor")), "cuts")
        fits = _moments(rows.join(met(cut), "g").where(_distance() <= F.col("cut")))
    best = fits.groupBy("g").agg(F.min_by(F.struct("mean", "inv"), F.struct("det", "start")).alias("x")).select("g", "x.*")
    half = chi_square_quantile(p, 0.0)

    def scaled(fit: DataFrame) -> DataFrame:
        far = rows.join(met(fit), "g").withColumn("d", _distance())
        by = far.groupBy("g", "l", one).agg(F.count("*").alias("n"), F.array(F.greatest(quantile("d", 0.5), F.lit(1e-12)) / half).alias("by"), *carried("mean", "inv"))
        by = stage_table(_shrunk(by, ["by"]).select("g", "mean", "inv", F.col("by")[0].alias("by")), "scales")
        return rows.join(met(by), "g").withColumn("d", _distance())

    near = scaled(best).where(F.col("d") <= F.col("by") * chi_square_quantile(p, 1.96))
    last = _moments(near.withColumns({"start": F.lit(0), "floor": F.array_repeat(F.lit(0.0), p)}), groups)
    return scaled(last.select("g", "mean", "inv")).withColumn("distance", F.col("d") / F.col("by")).drop("mean", "inv", "d", "by")


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the counts of STATS, base_failed, distance (null where base_failed) and kept, a row for each row of docs.

    ``docs(doc_id, text, lang, source, ...)``: a null language or source is one of its own, other columns are ignored. Null texts have
    no words; very long ones are measured whole. Rows that fail the base rules take no part in the estimates. Repeated rows count
    each and share a verdict. An empty table gives no rows.
    """
    stats = text_statistics(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"])
    stats = stage_table(_features(stats.withColumn("base_failed", base_failed())), "statistics")
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    good = stats.where("not base_failed").withColumns({"l": value("lang"), "g": F.concat_ws("\1", value("lang"), value("source"))})
    far = robust_distances(good).withColumn("kept", F.col("distance") <= chi_square_quantile(len(FEATURES), tail))
    columns = ["doc_id", *STATS, "base_failed"]
    bad = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return far.select(*columns, "distance", "kept").unionByName(bad)


def keep_good(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of docs, with their columns, whose doc_id no row was rejected under; rows without doc_id are not judged and stay."""
    bad = stage_table(quality_verdicts(docs, tail).where("not kept and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_IDS else bad, "doc_id", "left_anti").select(*docs.columns)
