"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of source, language and topic. Raking scales the cells in turn to the target share of each source,
each language and each topic until all three fit. A cell's weight is its fitted over its found share. A document of a cell is drawn
``rate * weight`` times on average: the whole part for certain, the rest by a hash of its id, so a draw can be repeated. No weight is
capped, so the drawn tokens of every source, language and topic are on average what was raked.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stage_table

DIMS = ["source", "lang", "topic"]
DRIVER_CELLS = 200_000  # cells are raked in memory up to this number, else as tables, by the same steps
TEMPERATURE = 0.7
BROADCAST_CELLS = 200_000  # cells of about 100 bytes; beyond, a shuffled join
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def form_topic(words: Column, text: str = "text") -> Column:
    """A topic by form, for tables that have none: markup, figures, dialogue, short, long or prose."""
    size = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(words == 0, "empty")
        .when(F.regexp_count(text, F.lit(r"[#*$%&|<>]")) > 0.02 * size, "markup")
        .when(F.regexp_count(text, F.lit("[0-9]")) > 0.05 * size, "figures")
        .when(F.regexp_count(text, F.lit(r"\?")) > 0.005 * size, "dialogue")
        .when(words < 100, "short")
        .when(words >= 1500, "long")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, topic: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens (words) and the three dimensions; nulls form the value (none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select("doc_id", "source", "lang", text.alias("text"), *keep, *([topic.alias("topic")] if topic is not None else []))
    counted = counted.withColumn("n_tokens", F.regexp_count("text", F.lit(WORD)).cast("long"))
    if topic is None:
        counted = counted.withColumn("topic", form_topic(F.col("n_tokens")))
    return counted.select("doc_id", "n_tokens", *keep, *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in DIMS))


def smoothed_targets(cells: DataFrame, temperature: float = TEMPERATURE) -> dict[str, DataFrame]:
    """Per dimension a table (value, target): shares raised to the temperature, which lifts the small."""
    out = {}
    for c in DIMS:
        sums = cells.groupBy(c).agg(F.sum("tokens").alias("tokens")).withColumn("p", F.pow(F.col("tokens").cast("double"), temperature))
        total = sums.agg(F.sum("p").alias("total"))
        out[c] = sums.crossJoin(F.broadcast(total)).select(F.col(c), (F.col("p") / F.col("total")).alias("target"))
    return out


def _rake_arrays(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    fitted = tokens / tokens.sum()
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets):
            have = np.bincount(code, fitted, len(target))
            off = max(off, float(np.abs(have - target).max()))
            fitted = fitted * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if off < tolerance:
            break
    return fitted, off


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``cells(source, lang, topic, tokens)`` with ``fitted`` (share after raking) and ``weight`` (fitted over found share).

    Values missing from a target table get target 0; targets are scaled to sum to 1 over the values that have tokens. Cells
    without tokens keep weight 0. No cells give no rows. Targets that no table can meet (a value without a partner) do not converge:
    a warning then tells by how much a share is off after the last round.
    """

    def settled(off: float) -> None:
        if off >= tolerance:
            warnings.warn(f"raking is off by {off:.3g} of all tokens after {rounds} rounds", stacklevel=3)
    cells = cells.where("tokens > 0")
    goal = {}
    for c in DIMS:
        held = cells.select(c).distinct().join(targets[c].groupBy(c).agg(F.sum("target").alias("target")), c, "left").fillna(0.0, ["target"])
        total = held.agg(F.sum("target").alias("total"))
        goal[c] = held.crossJoin(F.broadcast(total)).select(c, (F.col("target") / F.col("total")).alias("target"))
    if cells.count() <= DRIVER_CELLS:
        rows = cells.select(*DIMS, F.col("tokens").cast("double").alias("tokens")).orderBy(*DIMS).toPandas()
        if rows.empty:
            return cells.withColumns({"fitted": F.lit(0.0), "weight": F.lit(0.0)})
        codes, wanted = [], []
        for c in DIMS:
            t = goal[c].toPandas().sort_values(c).reset_index(drop=True)
            codes.append(rows[c].map({v: i for i, v in enumerate(t[c])}).to_numpy())
            wanted.append(t["target"].to_numpy(float))
        rows["fitted"], off = _rake_arrays(rows["tokens"].to_numpy(), codes, wanted, rounds, tolerance)
        settled(off)
        rows["weight"] = rows["fitted"] / (rows["tokens"] / rows["tokens"].sum())
        rows["tokens"] = rows["tokens"].astype("int64")
        return cells.sparkSession.createDataFrame(rows, "source string, lang string, topic string, tokens long, fitted double, weight double")
    total = cells.agg(F.sum("tokens").alias("total"))
    now = stage_table(cells.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("total")).withColumn("fitted", F.col("share")).drop("total"), "cells")
    for _ in range(rounds):
        off = 0.0
        for c in DIMS:
            have = now.groupBy(c).agg(F.sum("fitted").alias("have")).join(goal[c], c)
            off = max(off, have.agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0] or 0.0)
            now = stage_table(now.join(have, c).withColumn("fitted", F.col("fitted") * F.coalesce(F.try_divide("target", "have"), F.lit(0.0))).drop("have", "target"), "cells")
        if off < tolerance:
            break
    settled(off)
    return now.select(*DIMS, "tokens", "fitted", (F.col("fitted") / F.col("share")).alias("weight"))


def cell_weights(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """source, lang, topic and weight of the cells of :func:`with_cells` rows that have tokens."""
    sums = stage_table(cells.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    return stage_table(rake(sums, targets or smoothed_targets(sums.where("tokens > 0"), temperature)).select(*DIMS, "weight"), "weights")


def _copies(seed: int, rate: float) -> Column:
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / float(1 << 53)
    due = F.lit(rate) * F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("weight"))
    return F.floor(due + chance).cast("int")


def _weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(weights) if weights.count() <= BROADCAST_CELLS else weights, DIMS, "left")


def draw(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, temperature: float = TEMPERATURE, rate: float = 1.0, seed: int = 17) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, copies (times drawn) and kept (drawn at all), a row for each row of docs.

    ``docs(doc_id, text, source, lang, ...)``; other columns are ignored. Null sources and languages are the value (none). Documents
    without words have weight 1 (they carry no tokens to weigh). Repeated rows share one draw; a null doc_id is drawn like any other
    value. Very long texts count whole, so a document that holds much of its cell makes the cell's draw coarse. ``rate`` is the drawn
    over the found number of tokens. An empty table gives no rows.
    """
    cells = stage_table(with_cells(docs, topic), "counted")
    joined = _weighed(cells, cell_weights(cells, targets, temperature)).withColumn("copies", _copies(seed, rate))
    return joined.select("doc_id", *DIMS, "n_tokens", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("weight")).alias("weight"), "copies", (F.col("copies") > 0).alias("kept"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = TEMPERATURE, rate: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as it was drawn, with their columns as they are; see :func:`draw`."""
    weights = cell_weights(with_cells(docs), targets, temperature)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    counted = with_cells(docs.select("doc_id", "source", "lang", "text", row), keep=("row",))
    return _weighed(counted, weights).withColumn("copy", F.explode(F.array_repeat(F.lit(0), _copies(seed, rate)))).select("row.*")
