"""Benchmark decontamination by greedy string tiling.

The benchmark is the query set. Karp-Rabin hashes of ``least`` words are the seeds; documents and items that share seeds are found
by a join on them, and their matches are the maximal runs of seeds on a diagonal. The longest match whose words are unmarked is
marked first, others are cut back to their unmarked parts, and so on until none of ``least`` words is left. The marked share of
the item decides, so passages in another order count in full.

A benchmark of at most BROADCAST_BYTES is a sorted seed index in every task, and all documents pass it once. A larger one is
joined with the documents' seeds by shuffle; documents then travel as ids and places, and only the tiles come back to them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import bytesnp
from tracelake.llm.common import free_name, stage_table

BROADCAST_BYTES = 16 << 20  # of benchmark text; its index is about four times as large
HITS = 1 << 20  # pairs of equal seeds expanded at once
FOUND = "array<struct<item_id: bigint, n_words: int, n_covered: int, tiles: array<struct<at: int, item_at: int, n: int>>>>"
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("n_words", pa.int32()), ("n_covered", pa.int32()), ("tiles", pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("n", pa.int32())])))]))


def diagonals(hits: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (text word, item word, seeds) of the seed positions that come in parts; a part is reduced before the next."""
    at, item_at, size = (np.zeros(0, np.int64) for _ in range(3))
    for a, i in hits:
        at, item_at, size = np.append(at, a), np.append(item_at, i), np.append(size, np.ones(len(a), np.int64))
        order = np.lexsort((at, at - item_at))
        at, item_at, size = at[order], item_at[order], size[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at - item_at) != 0) | (at[1:] != at[:-1] + size[:-1])
        begin = np.flatnonzero(new)
        size = np.add.reduceat(size, begin) if len(begin) else size
        at, item_at = at[begin], item_at[begin]
    return at, item_at, size


def greedy(at: np.ndarray, item_at: np.ndarray, size: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (text word, item word, words) from runs of seeds; of equal lengths the first in the item, then in the text."""
    heap = [(-int(n), int(i), int(d)) for n, i, d in zip(size + least - 1, item_at, at)]
    heapq.heapify(heap)
    used_text: set[int] = set()
    used_item: set[int] = set()
    out = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = [d + j not in used_text and i + j not in used_item for j in range(n)]
        if all(free):
            out.append((d, i, n))
            used_text.update(range(d, d + n))
            used_item.update(range(i, i + n))
            continue
        start = None
        for j, ok in enumerate([*free, False]):
            if ok and start is None:
                start = j
            elif not ok and start is not None:
                if j - start >= least:
                    heapq.heappush(heap, (-(j - start), i + start, d + start))
                start = None
    return out


def tile(at: np.ndarray, item_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles from the positions of equal seeds."""
    return greedy(*diagonals(iter([(at, item_at)])), least)


def _found(item_id: int, n_words: int, tiles: list[tuple[int, int, int]]) -> dict:
    return {"item_id": item_id, "n_words": n_words, "n_covered": sum(t[2] for t in tiles), "tiles": [{"at": d, "item_at": i, "n": n} for d, i, n in tiles]}


def _expanded(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text place, item place) for each place of the sorted seeds from lo to hi, about HITS at a time."""
    ends = np.cumsum(hi - lo)
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(ends // HITS)) + 1):
        many = (hi - lo)[part]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(at[part], many), place[np.repeat(lo[part], many) + inside]


class Items:
    """Seeds of a benchmark: all of them sorted, and those of each item sorted."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.ids = [r[0] for r in rows]
        self.least = least
        seeds, item, at, self.size = [], [], [], []
        for n, (_, text) in enumerate(rows):
            data = np.frombuffer(text.encode(), np.uint8)
            h, _ = bytesnp.word_rows(data, np.array([0, len(data)]), lower=True)
            w = bytesnp.windows(h, least)
            order = np.argsort(w, kind="stable")
            self.size.append(len(h))
            seeds.append(w[order])
            item.append(np.full(len(w), n, np.int32))
            at.append(order.astype(np.int32))
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in seeds], dtype=np.int64)])
        self.own, item, self.at = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (seeds, item, at))
        order = np.argsort(self.own, kind="stable")
        self.seeds, self.item = self.own[order].astype(np.uint64), item[order]

    def search(self, h: np.ndarray, rows: np.ndarray) -> dict[int, list[dict]]:
        """What each row of a piece shares with the items; ``rows``: where each row's words begin."""
        runs = bytesnp.windows(h, self.least)
        lo, hi = np.searchsorted(self.seeds, runs, "left"), np.searchsorted(self.seeds, runs, "right")
        at = np.flatnonzero(hi > lo)
        row = np.searchsorted(rows, at, "right") - 1
        inside = at + self.least <= rows[row + 1]
        at, row = at[inside], row[inside]
        out: dict[int, list[dict]] = {}
        for r in np.unique(row).tolist():
            own = at[slice(*np.searchsorted(row, [r, r + 1]))]
            items = np.unique(np.concatenate([np.unique(x) for _, x in _expanded(own, lo[own], hi[own], self.item)]))
            for n in items.tolist():
                part = slice(self.first[n], self.first[n + 1])
                a, b = np.searchsorted(self.own[part], runs[own], "left"), np.searchsorted(self.own[part], runs[own], "right")
                held = np.flatnonzero(b > a)
                tiles = greedy(*diagonals(_expanded(own[held] - rows[r], a[held], b[held], self.at[part])), self.least)
                out.setdefault(r, []).append(_found(self.ids[n], self.size[n], tiles))
        return out


def _search(held, columns: list[str], text: str, name: str):
    def run(batches):
        items = held.value
        for batch in batches:
            for at, to, data, offs in bytesnp.pieces(batch.column(text)):
                h, rows = bytesnp.word_rows(data, offs, lower=True)
                hits = items.search(h, rows)
                own = [hits.get(r, []) for r in range(to - at)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[at:to] for c in columns), pa.array(own, _FOUND)], names=[*columns, name])

    return run


def seeds(texts: DataFrame, least: int) -> DataFrame:
    """``id, h, at, n``: the seeds of ``texts(id, text)``, where each begins and the words of its text."""

    def run(batches):
        for batch in batches:
            for at, to, data, offs in bytesnp.pieces(batch.column(1)):
                h, rows = bytesnp.word_rows(data, offs, lower=True)
                for r in range(to - at):
                    w = bytesnp.windows(h[rows[r] : rows[r + 1]], least)
                    if len(w):
                        one = [np.full(len(w), batch.column(0)[at + r].as_py()), w.view(np.int64), np.arange(len(w)), np.full(len(w), rows[r + 1] - rows[r])]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in one], names=["id", "h", "at", "n"])

    return texts.select("id", "text").mapInArrow(run, "id long, h long, at long, n long")


def _joined(docs: DataFrame, items: DataFrame, least: int, name: str) -> DataFrame:
    """Matches of a benchmark of any size: a join on seeds, tiles for each document and item, a list for each document."""
    key = free_name("row", [*docs.columns, name])
    docs = stage_table(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    items = stage_table(items.withColumn("id", F.monotonically_increasing_id()), "items")
    known = stage_table(seeds(items, least).withColumnsRenamed({"id": "item", "at": "item_at", "n": "n_words"}), "item-seeds")
    hits = seeds(docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("text")), least).drop("n").join(known, "h")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def parts():
            for batch in batches:
                held[:] = [batch.column(c)[0].as_py() for c in ("id", "item", "n_words")]
                yield batch.column("at").to_numpy(), batch.column("item_at").to_numpy()

        cut = greedy(*diagonals(parts()), least)
        row = {"id": held[0], "item": held[1]} | _found(0, held[2], cut)
        yield pa.RecordBatch.from_arrays([pa.array([row["id"]]), pa.array([row["item"]]), pa.array([row["n_words"]], pa.int32()), pa.array([row["n_covered"]], pa.int32()), pa.array([row["tiles"]], _FOUND.value_type.field("tiles").type)], names=["id", "item", "n_words", "n_covered", "tiles"])

    kinds = "id long, item long, n_words int, n_covered int, tiles array<struct<at: int, item_at: int, n: int>>"
    cuts = hits.select("id", "item", "n_words", "at", "item_at").groupBy("id", "item").applyInArrow(tiles, kinds)
    cuts = cuts.join(items.select(F.col("id").alias("item"), "item_id"), "item")
    listed = cuts.groupBy(F.col("id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("item_id", "n_words", "n_covered", "tiles"))).alias(name))
    out = docs.join(listed, key, "left").drop(key)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(FOUND)))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, name: str = "found") -> DataFrame:
    """``docs`` with a column ``name``: for each benchmark item that shares ``least`` words in a row, its tiles and covered words.

    Words are lower-cased runs of non-space. Null or empty texts, and items shorter than ``least`` words, match nothing (an empty
    list): so short an item occurs by chance. Rows and columns of docs stay as they are; repeated rows each get their list, and texts
    are searched whole. ``name`` must not be a column of docs, whatever its case. Repeated item ids are items of their own. An empty
    benchmark gives empty lists, an empty table no rows.
    """
    if free_name(name, docs.columns) != name:
        raise ValueError(f"docs has a column {name}")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        return _joined(docs, items, least, name)
    held = docs.sparkSession.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in items.collect()), key=str), least))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(FOUND))])
    return docs.mapInArrow(_search(held, docs.columns, "text", name), schema)


def contaminated(found: str = "found", share: float = 0.5):
    """Whether some item is covered to at least this share."""
    return F.exists(found, lambda x: x["n_covered"] >= share * x["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """doc_id, contaminated, item_ids (covered to ``share``, sorted) and coverage (the largest; 0 without a match), a row each.

    See :func:`benchmark_matches` for odd rows. Items of null id count, and their id is among item_ids.
    """
    found = benchmark_matches(docs.select("doc_id", "text"), benchmark, least)
    hit = F.filter("found", lambda x: x["n_covered"] >= share * x["n_words"])
    return found.select(
        F.col("doc_id"),
        contaminated(share=share).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform(hit, lambda x: x["item_id"]))).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["n_covered"] / x["n_words"])), F.lit(0.0)).alias("coverage"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    """The rows of docs that cover no benchmark item to ``share``, with their columns as they are."""
    mark = free_name("found", docs.columns)
    return benchmark_matches(docs, benchmark, least, mark).where(~contaminated(mark, share)).drop(mark)
