"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words, and the first 4 to 7 bytes of words, that mark toxic documents of a bounded sample of labelled
training rows; a few seed words stand beside it. Features of a whole text are densities of lexicon words, lexicon words near a
second person, capitals, punctuation and obfuscation. Lexicon and trees are fitted on one part of the training rows; the
calibration is fitted on another, whose labels neither has seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm import bytesnp
from tracelake.llm.common import stage_table

SAMPLE = 20_000  # labelled training rows, at most, that the lexicon, the trees and the calibration see
LEAST_HITS = 8  # toxic sample rows that must hold a term; with SAMPLE this bounds the lexicon
LEAST_ODDS = 2.5  # its log odds
PREFIXES = (4, 5, 6, 7)  # bytes; multi-byte letters make some of them odd, which costs nothing
#: Seed words in lower case, and second-person words of four languages.
SEED_WORDS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb imbecile idiota imbécile stupide dumm trottel estúpido basura".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split()
FEATURES = ["f_lexicon", "f_hits", "f_distinct", "f_odds", "f_most", "f_seed", "f_near", "f_caps", "f_shout", "f_points", "f_bang", "f_mask", "f_length"]
_POINT = np.isin(np.arange(256), list(b".,;:!?'\"-()"))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_ODD = np.isin(np.arange(256), list(b"0123456789@$!*#+_"))


def held_out(doc_id: Column) -> Column:
    """Whether the row's label may not be learned: crc32 of the id as text leaves remainder 2 by 4."""
    return F.coalesce(_fold(doc_id) == 2, F.lit(False))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _word_keys(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(bytesnp.word_rows(data, np.array([0, len(data)]), lower=True)[0])


def _terms(data: np.ndarray, offs: np.ndarray):
    """Trimmed words (start, end, row) and a hash for the word and for each prefix; 0 where the word is shorter."""
    s, e, row = bytesnp.spans(data, offs)
    for _ in range(3):  # up to three marks at either end
        s = np.where((e - s > 1) & _POINT[data[np.minimum(s, len(data) - 1)]], s + 1, s) if len(s) else s
        e = np.where((e - s > 1) & _POINT[data[e - 1]], e - 1, e) if len(e) else e
    c, inverse = bytesnp.prefix_hashes(data, lower=True), bytesnp.powers(len(data))[1]
    keys = [bytesnp.mix((c[e] - c[s]) * inverse[s])]
    for n in PREFIXES:
        h = bytesnp.mix((c[np.minimum(s + n, e)] - c[s]) * inverse[s] + bytesnp.U(n))
        keys.append(np.where(e - s > n, h, bytesnp.U(0)))
    return s, e, row, keys


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted term hashes and their log odds, from ``sample(text, toxic)`` of at most SAMPLE rows."""

    def count(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for at, to, data, offs in bytesnp.pieces(batch.column("text")):
                _, _, row, keys = _terms(data, offs)
                term, owner = np.concatenate(keys), np.tile(row, len(keys))
                pair = np.unique(bytesnp.mix(term + bytesnp.U(0x9E3779B97F4A7C15) * owner.astype(np.uint64)), return_index=True)[1]
                pair = pair[term[pair] != 0]
                yield pa.RecordBatch.from_arrays([pa.array(term[pair].view(np.int64)), pa.array(toxic[at:to][owner[pair]].astype(np.int64))], names=["term", "toxic"])

    n = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    good, bad = n["n"] - n["bad"], n["bad"]
    hits = sample.select("text", "toxic").mapInArrow(count, "term long, toxic long").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good + 1.0))
    rows = hits.withColumn("odds", odds).where((F.col("bad") >= LEAST_HITS) & (F.col("odds") >= LEAST_ODDS)).select("term", "odds").toPandas()
    keys = rows["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["odds"].to_numpy(float)[order]


def text_features(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and FEATURES, a row for each row; a null text is empty."""
    terms, odds = lexicon
    seeds, second = _word_keys(SEED_WORDS), _word_keys(SECOND_PERSON)

    def measure(batches):
        for batch in batches:
            for at, to, data, offs in bytesnp.pieces(batch.column("text")):
                n = to - at
                s, e, row, keys = _terms(data, offs)
                words = np.bincount(row, minlength=n).astype(float)
                size = np.maximum(np.diff(offs), 1).astype(float)
                worth = np.zeros(len(s))
                which = np.zeros(len(s), np.int64)
                for key in keys:
                    if len(terms):
                        i = np.minimum(np.searchsorted(terms, key), len(terms) - 1)
                        better = (terms[i] == key) & (odds[i] > worth)
                        worth[better] = odds[i][better]
                        which[better] = i[better] + 1
                seed = np.isin(keys[0], seeds)
                hit = (worth > 0) | seed
                you = np.isin(keys[0], second)
                near = np.zeros(len(s), bool)
                for d in (1, 2, 3):
                    near[d:] |= you[:-d] & (row[d:] == row[:-d])
                    near[:-d] |= you[d:] & (row[d:] == row[:-d])
                upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
                letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
                odd = np.concatenate([[0], np.cumsum(_ODD[data])])
                letters = letter[e] - letter[s]
                shout = (letters >= 3) & (upper[e] - upper[s] == letters)
                inner = (e - s >= 4) & (letters >= 2) & (odd[e - 1] - odd[np.minimum(s + 1, e - 1)] > 0)
                total = lambda x, w=None: np.bincount(row[x], None if w is None else w[x], n)
                some = np.maximum(words, 1)
                most = np.zeros(n)
                np.maximum.at(most, row[hit], worth[hit])
                kinds = np.unique(row[worth > 0] * (len(terms) + 1) + which[worth > 0]) // (len(terms) + 1)
                hits = total(hit)
                cols = [
                    hits / some, np.log1p(hits), np.log1p(np.bincount(kinds, minlength=n)), total(hit, worth) / some, most, np.log1p(total(seed)), total(hit & near) / some,
                    np.diff(upper[offs]) / size, total(shout) / some, np.diff(np.concatenate([[0], np.cumsum(_POINT[data])])[offs]) / size,
                    np.diff(np.concatenate([[0], np.cumsum(data == 33)])[offs]) / size, total(inner) / some, np.log1p(words),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at:to] for c in keep), *(pa.array(np.asarray(c, float)) for c in cols)], names=[*keep, *FEATURES])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(measure, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in FEATURES)]))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic and fold of at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    marks = labels.where("toxic is not null").select(F.col("doc_id").alias("marked"), F.col("toxic").cast("int").alias("toxic")).groupBy("marked").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("marked"))).orderBy(F.xxhash64("marked"), "marked").limit(sample)
    texts = docs.join(F.broadcast(marks), docs["doc_id"] == marks["marked"])  # at most ``sample`` ids
    return texts.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "toxic", _fold(F.col("doc_id")).alias("fold"))


def score_toxicity(docs: DataFrame, labels: DataFrame, rounds: int = 20, depth: int = 4, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of ``docs(doc_id, text, ...)``.

    ``labels(doc_id, toxic, ...)`` is learned from outside the held-out fold only; ids with several labels are toxic if one is.
    A null text is scored as an empty one, a null doc_id is never learned from nor held out. Very long texts are measured whole, one
    at a time. Repeated rows and ties get equal scores. Without labels of both kinds every score is the share of toxic labels, or 0.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stage_table(training_rows(docs, labels), "toxic-sample")
    lexicon = learn_lexicon(sample.where("fold < 2"))
    train = stage_table(text_features(sample, lexicon, ["toxic", "fold"]), "toxic-train")
    counts = {(r["fold"], r["toxic"]): r["count"] for r in train.groupBy("fold", "toxic").count().collect()}
    n = lambda folds, toxic: sum(counts.get((f, toxic), 0) for f in folds)
    rows = text_features(docs, lexicon, ["doc_id"])
    if min(n((0, 1), 0), n((0, 1), 1), n((3,), 0), n((3,), 1)) == 0:
        share = n((0, 1, 3), 1) / max(1, sum(counts.values()))
        scored = rows.select("doc_id", F.lit(share).alias("score"))
    else:
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, seed=7).fit(vector.transform(train.where("fold < 2")))
        raw = lambda df: trees.transform(vector.transform(df)).withColumn("raw", vector_to_array("probability")[1])
        held = raw(train.where("fold = 3")).select("raw", F.col("toxic").cast("double").alias("toxic"))
        bends = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(held)
        scored = bends.transform(raw(rows).select("doc_id", "raw")).select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
