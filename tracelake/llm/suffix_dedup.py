"""Suffix-array removal of byte strings that occur more than once.

1. Equal whole texts are one class. The bytes of a text of at least ``length`` bytes with a copy are all repeated.
2. Each text of a class of its own, or the first of a class, is fingerprinted by winnowing: of every window of ``WINNOW``
   consecutive grams the smallest hash is an anchor. A string of ``length`` bytes always holds an anchor, and equal strings hold
   the same one, so only anchors found twice can lie in a repeated string.
3. An anchor found twice has as leader the first text that holds it. The bytes within reach of a text's anchors of one leader
   form the text's parts of that leader's shard; a long part is cut, and each piece owns the starts up to the next. Small leaders
   share shards; large leaders are cut into several, and each pair of these meets once.
4. A shard sorts its suffixes by Larsson-Sadakane refinement (numpy) and takes common
   prefixes of neighbours in Kasai's order, many stretches of text at a time. A suffix whose common prefix with a neighbour of
   another start reaches ``length`` begins a repeated string.
5. Two shards of one leader are merged by binary search of the one's sorted suffixes in the other's.
6. Spans of all shards are joined per text and cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import bytesnp
from tracelake.llm.common import stage_table, with_leaders

SHARD = 1 << 21  # bytes of text sorted together
TASKS = 20_000  # most tasks of the suffix sorts; each then sorts several shards, one after another


def winnow(data: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the grams that are smallest in some window of so many grams (the first of equals)."""
    m = len(data) - gram + 1
    if m < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    c = bytesnp.prefix_hashes(data)
    h = bytesnp.mix((c[gram:] - c[:m]) * bytesnp.powers(len(data))[1][:m])
    block = -(-m // window) * window
    padded = np.full(block, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = h
    rows = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(back[: m - window + 1], ahead[window - 1 : m])
    # a gram is chosen if it equals the smallest of a window that it is in; equal grams of a window are all chosen
    most = np.empty(m, np.uint64)
    n = len(low)
    lo = np.zeros(-(-(m + window) // window) * window + window, np.uint64)
    lo[window - 1 : window - 1 + n] = low
    r = lo[: len(lo) // window * window].reshape(-1, window)
    fore, aft = np.maximum.accumulate(r, 1).ravel(), np.maximum.accumulate(r[:, ::-1], 1)[:, ::-1].ravel()
    most = np.maximum(aft[:m], fore[window - 1 : window - 1 + m])
    at = np.flatnonzero(h == most)
    return at, h[at]


def refine(data: np.ndarray, ends: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Suffix array of data by Larsson-Sadakane: ranks after h bytes give those after 2h; only ties are sorted again.

    ``part[i]`` holds byte i and ends at ``ends[i]``; a suffix stops there. Ends sort first, and among themselves by part.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    left = ends - np.arange(n)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(7):
        key = (key << np.uint64(8)) | np.where(left > j, wide[j : j + n], 0).astype(np.uint64)
    key = (key << np.uint64(8)) | np.minimum(left, 7).astype(np.uint64)
    sa = np.argsort(key)
    sorted_key = key[sa]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 7
    while True:
        lone = head.copy()
        lone[:-1] &= head[1:]
        open_ = np.flatnonzero(~lone)  # places in ties
        if not len(open_):
            break
        at = sa[open_]
        group = rank[at]
        nxt = np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + n, n - 1 - part[at])
        order = np.argsort(group * (2 * n + 1) + nxt)
        at, group, nxt = at[order], group[order], nxt[order]
        sa[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        head[open_] = new
        rank[at] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2
    return sa


def kasai(data: np.ndarray, ends: np.ndarray, sa: np.ndarray, most: int, stretch: int = 256) -> np.ndarray:
    """Common prefix (at most ``most``) of each suffix with the one before it in ``sa``, by place in sa.

    Kasai's scan in text order: the prefix at i + 1 is at least that at i less one. Stretches of the text advance together.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(wide, (n + most + 8, 8), (1, 1))
    out = np.zeros(n, np.int64)
    starts = np.arange(0, n, stretch)
    held = np.zeros(len(starts), np.int64)
    for step in range(min(stretch, n)):
        i = starts + step
        i = i[i < n]
        j = before[i]
        held = np.maximum(held[: len(i)] - 1, 0)
        held[j < 0] = 0
        live = np.flatnonzero((j >= 0) & (held < most))
        while len(live):
            a, b = i[live] + held[live], j[live] + held[live]
            same = eight[a] == eight[b]
            run = np.where(same.all(1), 8, np.argmin(same, 1))
            held[live] += run
            held[live] = np.minimum(held[live], np.minimum(most, np.minimum(ends[i[live]] - i[live], ends[j[live]] - j[live])))
            live = live[(run == 8) & (held[live] < np.minimum(most, np.minimum(ends[i[live]] - i[live], ends[j[live]] - j[live])))]
        out[i] = held
    return out[sa]


def _parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all parts one after another; per byte its part and the part's end; per part its first byte."""
    col = table.column("part").combine_chunks().cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    size = np.diff(offs)
    return data, np.repeat(np.arange(len(size)), size), np.repeat(offs[1:], size), offs[:-1]


def repeated_starts(data, ends, part, length: int, origin, own) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the owned starts of strings that occur at two owned places, and the suffix array.

    ``origin`` names the place of a byte in the input: parts of different leaders can overlap, and a place isn't its own repeat.
    """
    sa = refine(data, ends, part)
    same = kasai(data, ends, sa, length) >= length
    hit = np.zeros(len(data), bool)
    if not len(sa):
        return hit, sa
    first = np.flatnonzero(~same)  # suffixes equal for the whole length stand together
    at, mine = origin[sa], own[sa]
    low = np.minimum.reduceat(np.where(mine, at, np.iinfo(np.int64).max), first)
    high = np.maximum.reduceat(np.where(mine, at, -1), first)
    hit[sa] = np.repeat(low < high, np.diff(np.append(first, len(sa)))) & mine
    return hit, sa


def _search(data, ends, own, sa, other, starts, length: int) -> np.ndarray:
    """Binary search of the strings of so many bytes at ``starts`` of other among the owned, sorted suffixes of data."""
    found = np.zeros(len(starts), bool)
    full = sa[own[sa] & (ends[sa] - sa >= length)]
    if not len(full) or not len(starts):
        return found
    words = -(-length // 8)

    def packed(text, at, w):
        lo = at + np.minimum(8 * w, length - 8)  # the last word overlaps the one before it
        out = np.zeros(len(at), np.uint64)
        for j in range(8):
            out = (out << np.uint64(8)) | text[lo + j].astype(np.uint64)
        return out

    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(full), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        less, tie = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for w in range(words):
            t = np.flatnonzero(tie)
            if not len(t):
                break
            x, y = packed(data, full[mid[t]], w), packed(other, starts[open_[t]], w)
            less[t] = x < y
            tie[t] = x == y
        found[open_[tie]] = True
        lo[open_] = np.where(tie, hi[open_], np.where(less, mid + 1, lo[open_]))
        hi[open_] = np.where(tie | less, hi[open_], mid)
    return found


def _shard(length: int):
    schema = pa.schema([("uid", pa.int64()), ("spans", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        uid, first, owned, side = (table.column(c).to_numpy() for c in ("uid", "first", "own", "side"))
        data, part, ends, begin = _parts(table)
        inside = np.arange(len(data)) - begin[part]
        where, own = inside + first[part], inside < owned[part]  # place in its text, and whether it is a start of this part
        texts = np.unique(uid, return_inverse=True)[1]
        origin = texts[part] * (1 << 40) + where
        hit = np.zeros(len(data), bool)
        sides = []
        for which in np.unique(side):
            at = np.flatnonzero(side[part] == which)
            edge = np.flatnonzero(np.diff(part[at], prepend=-1) != 0)  # first bytes of parts within this side
            nth = np.cumsum(np.diff(part[at], prepend=-1) != 0) - 1
            end = np.append(edge[1:], len(at))[nth]
            found, sa = repeated_starts(data[at], end, nth, length, origin[at], own[at])
            hit[at] |= found
            sides.append((at, data[at], end, own[at], sa))
        if len(sides) == 2:
            for (_, d, e, o, sa), (at, d2, e2, o2, _) in (sides, sides[::-1]):
                ask = np.flatnonzero(~hit[at] & o2 & (e2 - np.arange(len(at)) >= length))
                hit[at[ask[_search(d, e, o, sa, d2, ask, length)]]] = True
        s, e = _runs_by_part(hit, part, length)
        if not len(s):
            return schema.empty_table()
        rows = part[s]
        cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        flat = np.stack([where[s], where[s] + (e - s)], 1).ravel()
        spans = pa.ListArray.from_arrays(pa.array(np.r_[cuts * 2, len(flat)].astype(np.int32)), pa.array(flat))
        return pa.table({"uid": uid[rows[cuts]], "spans": spans}, schema=schema)

    return run


def _runs_by_part(hit: np.ndarray, part: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.flatnonzero(hit)
    if not len(s):
        return s, s
    cut = np.flatnonzero((np.diff(s) > length) | (np.diff(part[s]) != 0))
    return s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]] + length


def merge_spans(spans: list[int]) -> list[tuple[int, int]]:
    """Joined spans of a flat list of starts and ends; spans that touch are one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _named(docs: DataFrame) -> DataFrame:
    """text, sha, size in bytes, and uid: 60 bits of the SHA-256, by which copies are one text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    named = named.withColumns({"sha": F.sha2(F.col("text").cast("binary"), 256), "size": F.octet_length("text").cast("long")})
    return named.withColumn("uid", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))


def _anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            key, at_, hash_ = [], [], []
            for at, to, data, offs in bytesnp.pieces(batch.column(1)):
                for r in range(to - at):
                    p, h = winnow(data[offs[r] : offs[r + 1]], gram, length - gram + 1)
                    key.append(np.full(len(p), uids[at + r], np.int64))
                    at_.append(p)
                    hash_.append(h.view(np.int64))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (key, at_, hash_)], names=["uid", "at", "h"])

    return run


def _cut(length: int, gram: int, most: int):
    """Parts of a text by leader; a part has at most ``most`` starts of its own."""
    reach = length - gram

    def run(batches):
        for batch in batches:
            for uid, near, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "near", "text"))):
                out: dict[str, list] = {"uid": [], "lead": [], "first": [], "own": [], "part": []}
                text = text.encode()
                for x in near:
                    for s, e in merge_spans([y for p in x["at"] for y in (max(0, p - reach), min(len(text), p + gram + reach))]):
                        for a in range(s, max(s + 1, e - length + 1), most):
                            out["uid"].append(uid)
                            out["lead"].append(x["lead"])
                            out["first"].append(a)
                            out["own"].append(min(most, e - a))
                            out["part"].append(text[a : min(e, a + most + length - 1)])
                yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("uid", "lead", "first", "own")), pa.array(out["part"], pa.binary())], names=list(out))

    return run


def _near(listed: DataFrame) -> DataFrame:
    """``uid, near``: for each text with an anchor found twice the leaders and its anchors of each."""
    found = with_leaders(listed, "h", "uid").groupBy("uid", "lead").agg(F.collect_list("at").alias("at"))
    return found.groupBy("uid").agg(F.collect_list(F.struct("lead", "at")).alias("near"))


def _kept(batches):
    for batch in batches:
        out: dict[str, list] = {"uid": [], "spans": [], "kept": []}
        for uid, text, found in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "spans"))):
            text, at, kept, cuts = text.encode(), 0, [], merge_spans(found)
            for s, e in cuts:
                kept.append(text[at:s])
                at = e
            out["uid"].append(uid)
            out["spans"].append([x for cut in cuts for x in cut])
            out["kept"].append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([pa.array(out["uid"], pa.int64()), pa.array(out["spans"], pa.list_(pa.int64())), pa.array(out["kept"], pa.binary())], names=list(out))


def remaining_texts(named: DataFrame, length: int) -> DataFrame:
    """``uid, spans, kept`` of the distinct texts that hold a string repeated in them or in another text."""
    gram = length - length // 4
    long_ = named.where(F.col("size") >= length)
    listed = stage_table(long_.select("uid", "text").mapInArrow(_anchors(length, gram), "uid long, at long, h long").distinct(), "anchors")
    near = stage_table(_near(listed), "near")
    one = long_.groupBy("uid").agg(F.first("text").alias("text")).join(near.select("uid"), "uid", "left_semi")
    one = stage_table(one, "near-texts")
    kinds = "uid long, lead long, first long, own long, part binary"
    parts = stage_table(near.join(one, "uid").mapInArrow(_cut(length, gram, max(1, SHARD // 4)), kinds), "parts")
    size = parts.groupBy("lead").agg(F.sum(F.octet_length("part")).alias("bytes"))
    size = stage_table(size.withColumn("k", F.when(F.col("bytes") > SHARD, F.ceil(F.col("bytes") * 2 / SHARD)).cast("int")), "sizes")
    total = size.agg(F.sum("bytes").alias("bytes"), F.sum(F.col("bytes") * F.coalesce(F.col("k") - 1, F.lit(1))).alias("dealt")).first()
    shards = max(1, (total["bytes"] or 0) * 4 // SHARD)
    big = size.where("k is not null").select("lead", "k")
    dealt = parts.join(big, "lead", "left").withColumn("s", F.pmod(F.xxhash64("uid", "first"), F.col("k")).cast("int"))
    small = F.expr(f"array(named_struct('g', pmod(xxhash64(lead), {shards}), 'i', 0, 'j', 0, 'side', 0))")
    large = F.expr("transform(filter(sequence(0, k - 1), x -> x <> s), x -> named_struct('g', lead, 'i', 1 + least(s, x), 'j', 1 + greatest(s, x), 'side', if(s <= x, 0, 1)))")
    dealt = dealt.withColumn("x", F.explode(F.when(F.col("k").isNull(), small).otherwise(large))).select("uid", "first", "own", "part", "x.*")
    tasks = min(TASKS, max(named.sparkSession.sparkContext.defaultParallelism, (total["dealt"] or 0) * 4 // SHARD))
    dealt = dealt.repartition(tasks, "g", "i", "j")  # else adaptive execution, which goes by bytes, puts hours of sorting in one task
    spans = stage_table(dealt.groupBy("g", "i", "j").applyInArrow(_shard(length), "uid long, spans array<long>"), "spans")
    spans = spans.groupBy("uid").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    return one.join(spans, "uid").mapInArrow(_kept, "uid long, spans array<long>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """Cut from ``docs(doc_id, text, ...)`` every byte that a string of ``length`` bytes covers which starts twice or more.

    Returns a row for each row of docs: doc_id, n_bytes, sha (of the whole text), spans (flat starts and ends of what goes; null
    if nothing goes) and kept (what stays, as bytes; null if nothing goes). Other columns are ignored. A null text is empty.
    Repeated rows are copies of each other, so a text of that length goes whole. Matches never cross texts; an empty table
    gives no rows. ``length`` is at least 16.
    """
    named = _named(docs)
    cuts = stage_table(remaining_texts(named, length), "kept")
    rows = named.drop("text")
    copied = rows.where(F.col("size") >= length).groupBy("uid").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = rows.join(copied, "uid", "left").join(cuts, "uid", "left")
    whole = F.col("copies").isNotNull()
    return rows.select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        "sha",
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("size"))).otherwise(F.col("spans")).alias("spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def repeat_digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (whether anything goes) of :func:`remove_repeats`."""
    return remove_repeats(docs, length).select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.col("n_bytes") - F.octet_length("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), F.col("sha")).alias("kept_sha256"),
        F.col("spans").isNotNull().alias("repeated"),
    )
