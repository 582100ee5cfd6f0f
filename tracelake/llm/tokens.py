"""Token counts with offset-mapped attribution.

Each whole text is encoded once by a byte-level BPE. The byte lengths of its tokens give their spans, and an interval join of these
with the spans of the text's sections (both sorted, so a binary search) gives each section its tokens. Sections are the lines of a
text or the fields of a row. Spans are in bytes, as a token may end inside a character; every border between characters is one
between bytes. A token that crosses a
border belongs by an explicit rule: ``start`` to the section of its first byte, ``most`` to the one that holds most of its bytes (the
first of equals), ``split`` to each by its share of bytes.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "most", "split")
#: The split pattern that the vocabulary was built with (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def token_sizes(text: str, vocabulary: str) -> np.ndarray:
    """Byte lengths of the tokens of a text, in order; they sum to its bytes."""
    encoding, size = _encoding(vocabulary)
    return size[encoding.encode_ordinary(text)] if text else np.zeros(0, np.int64)


def line_sections(data: bytes) -> np.ndarray:
    """Borders of the lines of a text, each with its line break: starts and, last, the end. An empty text has no section."""
    if not data:
        return np.zeros(1, np.int64)
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], at, [len(data)]]))


def attribute(sizes: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section (numbers, or shares by ``split``) and how many tokens cross a border."""
    n = len(borders) - 1
    if not n or not len(sizes):
        return np.zeros(n), 0
    end = np.cumsum(sizes)
    start = end - sizes
    first = np.searchsorted(borders, start, "right") - 1
    last = np.searchsorted(borders, end, "left") - 1
    cross = np.flatnonzero(last > first)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), len(cross)
    whole = np.ones(len(sizes), bool)
    whole[cross] = False
    out = np.bincount(first[whole], minlength=n).astype(float)
    for t in cross:
        parts = np.arange(first[t], last[t] + 1)
        held = np.minimum(borders[parts + 1], end[t]) - np.maximum(borders[parts], start[t])
        if rule == "most":
            out[parts[np.argmax(held)]] += 1
        else:
            out[parts] += held / sizes[t]
    return out, len(cross)


def token_counts(docs: DataFrame, vocabulary: str, rule: str = "start", fields: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing and section_tokens, a row for each row of docs.

    ``docs(doc_id, text, ...)``: section_tokens has a number for each line of text, with its line break. Where ``fields`` are given,
    these columns joined by line breaks are the document, and section_tokens has a number for each, with the break after it. Other
    columns are ignored. A null field is empty; a null or empty text has no tokens and no lines. Texts are encoded whole, one at a
    time, however long. Whatever the rule, section_tokens sums to n_tokens. Repeated rows count each; an empty table gives no rows.
    ``vocabulary`` is the path of a rank file where the driver runs; Spark sends it to the executors.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches):
        ranks = SparkFiles.get(name)
        for batch in batches:
            total, sections, crossing, each = [], [], [], []
            for text, sizes in zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist()):
                held = token_sizes(text, ranks)
                borders = line_sections(text.encode()) if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
                tokens, cross = attribute(held, borders, rule)
                total.append(len(held))
                sections.append(len(borders) - 1)
                crossing.append(cross)
                each.append(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (total, sections, crossing)), pa.array(each, pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields or ["text"]]
    whole = [x for c in texts for x in (c, F.lit("\n"))][:-1]
    sizes = F.array(*(F.octet_length(c) + int(i < len(texts) - 1) for i, c in enumerate(texts))) if fields else F.lit(None).cast("array<int>")
    return docs.select("doc_id", F.concat(*whole).alias("text"), sizes.alias("sizes")).mapInArrow(count, f"doc_id {kind}, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
