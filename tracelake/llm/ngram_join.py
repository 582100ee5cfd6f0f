"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, then exact sorted-array intersection.

Steps, all of them Spark jobs over the whole table:

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Equal sets are one class, kept by its smallest id.
2. A class lists its prefix: with threshold t, two sets that link share one of the first n - ceil(t n) + 1 members in any fixed
   order. The order is by hash, shingles that many documents share last.
3. Each listed shingle has as leader the smallest class that lists it; classes with the same leader may link. That replaces
   one group for each shared shingle by few groups for each class.
4. Large leader groups are cut into tiles of size bands and hashed blocks, so no task holds a whole group. Sizes more than 1/t
   apart never meet.
5. In a tile the parity bitmaps bound each overlap from above. Pairs that pass join documents to likely groups; each document
   is in one at most, and only there does its text travel.
6. Tiles of the likely groups compare every pair that sharper bitmaps let pass exactly. A pair meets in one tile, so each true
   link is found once; :func:`ngram_jaccard_links` gives them all, :func:`ngram_jaccard_components` counts them for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import bytesnp
from tracelake.llm.common import connected_components, stage_table, with_leaders

HOT_BLOCK = 1 << 21  # shingles counted together in a task
HOT_LOCAL = 16  # a shingle is common if it has this mean count a block; so at most HOT_BLOCK / HOT_LOCAL are common
TILE = 8192  # weight of one side of a tile of bitmaps, of two bits and up to four a shingle
TEXT_TILE = 8192  # ... of a tile of texts
WEIGH = 512  # shingles that weigh as much as a document of none, so a side holds WEIGH * TILE shingles at most
TILE_KEY = ["lead", "b", "t", "i", "j"]
ROUGH, SHARP = 2, 8  # bits for each shingle of bitmaps that travel, and of those made within a tile
SALTS = 64  # parts of a large group that meet its size
PART = 1 << 20  # shingles compared, and links given out, at once
BROADCAST_ROWS = 500_000  # ids and tiles, 64 bytes a row; beyond, a shuffled join


def bits_for(n: int, by: int) -> int:
    """A power of two of at least ``by`` bits for each shingle."""
    return max(64, 1 << (by * max(int(n), 1) - 1).bit_length())


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _bitmap(u: np.ndarray, by: int = ROUGH) -> bytes:
    bits = bits_for(len(u), by)
    odd = np.bincount((u & bytesnp.U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that are common over the whole table; at most 2 * HOT_BLOCK / HOT_LOCAL of them."""

    def count(batches):
        held, n, blocks = [], 0, 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= HOT_LOCAL // 2
            return pa.RecordBatch.from_arrays([pa.array(np.append(keys[keep].view(np.int64), 0)), pa.array(np.append(counts[keep], n)), pa.array([False] * int(keep.sum()) + [True])], names=["tok", "c", "total"])

        for batch in batches:
            for _, _, data, offs in bytesnp.pieces(batch.column(0)):
                for u in bytesnp.shingle_sets(data, offs, k):
                    held.append(u)
                    n += len(u)
                if n >= HOT_BLOCK:
                    yield flush()
                    held, n, blocks = [], 0, blocks + 1
        if n:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "tok long, c long, total boolean").groupBy("total", "tok").agg(F.sum("c").alias("c"))
    counts = stage_table(counts, "common")
    total = counts.where("total").agg(F.sum("c")).first()[0] or 0
    least = max(2 * HOT_LOCAL, total * HOT_LOCAL // (2 * HOT_BLOCK))
    rows = counts.where((~F.col("total")) & (F.col("c") >= least)).select("tok").toPandas()
    return np.sort(rows["tok"].to_numpy(np.int64).view(bytesnp.U))


def _sums(u: np.ndarray) -> tuple:
    """Two sums that name a set."""
    return u.sum(dtype=bytesnp.U), bytesnp.mix(u ^ bytesnp.U(0x5851F42D4C957F2D)).sum(dtype=bytesnp.U)


def _signed(x: list) -> pa.Array:
    return pa.array(np.array(x, bytesnp.U).view(np.int64))


def signatures(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """doc_id, size of the shingle set, the sums that name it, its prefix and its parity bitmap."""

    def sign(batches):
        for batch in batches:
            for at, to, data, offs in bytesnp.pieces(batch.column(1)):
                sets = bytesnp.shingle_sets(data, offs, k)
                d1, d2 = zip(*map(_sums, sets))
                toks = []
                for u in sets:
                    late = np.isin(u, common, assume_unique=True) if len(common) else np.zeros(len(u), bool)
                    first = np.concatenate([u[~late], u[late]]) if late.any() else u
                    toks.append(first[: prefix_length(len(u), num, den) if len(u) else 0])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], pa.array([len(u) for u in sets], pa.int64()), _signed(d1), _signed(d2), bytesnp.lists(toks), pa.array([_bitmap(u) for u in sets], pa.binary())], names=["doc_id", "n", "d1", "d2", "toks", "bitmap"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, d1 long, d2 long, toks array<long>, bitmap binary")


def tiles(members: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Deal ``members(lead, doc, n, ...)`` to tiles: one for a small group, else size bands times pairs of hashed blocks.

    The sizes of large groups, at most a row for ``most`` members, meet their members by lead and salt: a large group is spread
    over tasks here, and its tiles are shuffled apart afterwards and don't stay where their lead is. ``most`` is a weight: that of
    documents and their shingles together, so a tile of long texts holds fewer.
    """
    members = members.withColumn("band", F.floor(F.log("n") / float(np.log(den / num))).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    size = members.groupBy("lead").agg(F.sum(1 + F.col("n") / WEIGH).alias("size"), F.collect_set("band").alias("bands"))
    big = size.where(F.col("size") > most).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    m = members.join(big, ["lead", "salt"], "left").withColumn("k", F.ceil(F.col("size") / most).cast("int")).withColumn("s", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int"))
    one = F.array(F.struct(F.lit(0).alias("b"), F.lit(-1).alias("t"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    many = F.expr("""flatten(transform(sequence(0, k - 1), x -> filter(array(
        named_struct('b', band, 't', 0, 'i', least(s, x), 'j', greatest(s, x), 'side', if(s <= x, 0, 1)),
        if(array_contains(bands, band + 1), named_struct('b', band, 't', 1, 'i', s, 'j', x, 'side', 0), null),
        if(array_contains(bands, band - 1), named_struct('b', band - 1, 't', 1, 'i', x, 'j', s, 'side', 1), null)), y -> y is not null)))""")
    return m.withColumn("tile", F.explode(F.when(F.col("k").isNull(), one).otherwise(many))).select("*", "tile.*").drop("tile", "size", "bands", "k", "band", "s", "salt")


class Bitmaps:
    """Bitmaps of a tile by their length; two lengths meet at the shorter, the longer folded by exclusive or.

    Sets that can link differ in size by less than two, so a bitmap is needed at its own length and at half of it.
    """

    def __init__(self, maps: list[bytes]):
        self.level = np.array([len(x) // 8 for x in maps])
        self.rows: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for words in np.unique(self.level).tolist():
            held = np.flatnonzero((self.level == words) | (self.level == 2 * words))
            self.place[words] = np.full(len(maps), -1)
            self.place[words][held] = np.arange(len(held))
            self.rows[words] = np.array([np.bitwise_xor.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, words), 0) for i in held])

    def differ(self, i: int, js: np.ndarray) -> np.ndarray:
        """Bits in which i and each of js differ: at most the size of their symmetric difference."""
        out = np.zeros(len(js), np.int64)
        meet = np.minimum(self.level[js], self.level[i])
        for words in np.unique(meet).tolist():
            at = np.flatnonzero(meet == words)
            rows, place = self.rows[words], self.place[words]
            out[at] = np.bitwise_count(rows[place[js[at]]] ^ rows[place[i]]).sum(1, dtype=np.int64)
        return out


def _candidates(table: pa.Table, maps: Bitmaps, num: int, den: int):
    """Yield (row i, rows j after it or on the other side) for pairs that the bitmaps cannot rule out."""
    n = table.column("n").to_numpy()
    side = table.column("side").to_numpy()
    t, i0, j0 = (table.column(c)[0].as_py() for c in ("t", "i", "j"))
    split = t == 1 or t == 0 and i0 != j0
    order = np.argsort(n, kind="stable")
    left = order[side[order] == 0] if split else order
    right = order[side[order] == 1] if split else order
    rn = n[right]
    for p, i in enumerate(left):
        a, b = np.searchsorted(rn, -(-n[i] * num // den)) if split else p + 1, np.searchsorted(rn, n[i] * den // num, "right")
        for c in range(a, b, 4096):
            js = right[c : min(b, c + 4096)]
            both = n[i] + n[js]
            # overlap <= (both - differ) / 2 and a link needs overlap >= both * num / (num + den)
            js = js[(both - maps.differ(i, js)) * (num + den) >= 2 * num * both]
            if len(js):
                yield int(i), js


def _join(head: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """Give the groups of js the head of i; returns a j of each group that was another."""
    heads, at = np.unique(head[js], return_index=True)
    new = heads != head[i]
    if new.any():
        head[np.isin(head, heads[new])] = head[i]
    return js[at[new]]


def _pairs(doc: np.ndarray, a: list[int], b: list[int]) -> dict[str, pa.Array]:
    return {"a": pa.array(doc[np.array(a, np.int64)]), "b": pa.array(doc[np.array(b, np.int64)])}


def _joined(num: int, den: int):
    """Pairs that join the documents of a tile which the bitmaps let pass: at most one for each document."""

    def run(table: pa.Table) -> pa.Table:
        head = np.arange(table.num_rows)
        a, b = [], []
        if table.num_rows > 1:
            for i, js in _candidates(table, Bitmaps(table.column("bitmap").to_pylist()), num, den):
                new = _join(head, i, js)
                a += [i] * len(new)
                b += new.tolist()
        return pa.table(_pairs(table.column("doc").to_numpy(), a, b))

    return run


def _true(table: pa.Table, k: int, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (row i, rows j, overlaps) of the true links of a tile, each link once."""
    sets = [u for _, _, data, offs in bytesnp.pieces(table.column("text")) for u in bytesnp.shingle_sets(data, offs, k)]
    if len(sets) < 2:
        return
    doc = table.column("doc").to_numpy()
    _, place, times = np.unique(doc, return_inverse=True, return_counts=True)
    twice, met = times[place] > 1, set()  # rows that share a doc_id meet others more than once
    n = np.array([len(u) for u in sets])
    shingles, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[item] > 1  # a shingle of one set only is in no overlap
    item = item[shared]
    start = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(n)])]
    held, inside = np.diff(start), np.zeros(len(shingles), bool)
    for i, js in _candidates(table, Bitmaps([_bitmap(u, SHARP) for u in sets]), num, den):
        js = js[(held[js] > 0) & (doc[js] != doc[i])]
        inside[item[start[i] : start[i + 1]]] = True
        ends = np.cumsum(held[js])
        for part in np.split(js, np.flatnonzero(np.diff(ends // PART)) + 1):
            if not len(part):
                continue
            # the sets of a part one after another; each set's overlap is a sum over its stretch
            size = held[part]
            to = np.cumsum(size)
            at = np.arange(to[-1]) + np.repeat(start[part] - (to - size), size)
            overlap = np.add.reduceat(inside[item[at]].astype(np.int64), to - size)
            true = den * overlap >= num * (n[i] + n[part] - overlap)
            if twice.any():
                for x in np.flatnonzero(true & (twice[part] | twice[i])).tolist():
                    pair = tuple(sorted((int(doc[i]), int(doc[part[x]]))))
                    true[x] = pair not in met
                    met.add(pair)
            if true.any():
                yield i, part[true], overlap[true]
        inside[item[start[i] : start[i + 1]]] = False


def _links(k: int, num: int, den: int):
    """All true links of a tile, a < b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        doc = table.column("doc").to_numpy()
        held, n = [], 0

        def flush():
            a, b, both = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(both)], names=["a", "b", "overlap"])

        for i, js, overlap in _true(table, k, num, den):
            held.append((np.full(len(js), doc[i]), doc[js], overlap))
            n += len(js)
            if n >= PART:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _counts(k: int, num: int, den: int):
    """For each document of a tile that has true links their number (b is null), and links that join what they all join (n is null)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc = table.column("doc").to_numpy()
        head, n = np.arange(len(doc)), np.zeros(len(doc), np.int64)
        a, b = [], []
        for i, js, _ in _true(table, k, num, den):
            n[i] += len(js)
            n[js] += 1
            new = _join(head, i, js)
            a += [i] * len(new)
            b += new.tolist()
        some = np.flatnonzero(n)
        out = _pairs(doc, [*a, *some.tolist()], [*b, *some.tolist()])
        link = np.arange(len(a) + len(some)) < len(a)
        out["b"] = pa.array(out["b"].to_numpy(), mask=~link)
        return pa.table(out | {"n": pa.array(np.concatenate([np.zeros(len(a), np.int64), n[some]]), mask=link)})

    return run


def _dealt(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, bool]:
    """Members of ``docs``, the texts of class representatives in their tiles, and whether a pair can meet in more than one."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage_table(signatures(known, k, num, den, common_shingles(known, k)), "signatures")
    keyed = signed.where("n > 0 and doc_id is not null")
    classes = keyed.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("toks", "bitmap"), "doc_id").alias("x"))
    classes = stage_table(classes.select("n", "d1", "d2", "rep", "x.toks", "x.bitmap"), "classes")
    one = classes.select(F.col("rep").alias("doc"), "n", "bitmap")
    listed = with_leaders(classes.select(F.col("rep").alias("doc"), F.explode("toks").alias("tok")), "tok", "doc")
    found = stage_table(listed.where("doc <> lead").select("lead", "doc").distinct(), "groups")
    groups = found.unionByName(found.select("lead", F.col("lead").alias("doc")).distinct()).join(one, "doc")
    likely = tiles(groups, num, den, TILE).groupBy(*TILE_KEY).applyInArrow(_joined(num, den), "a long, b long")
    part = stage_table(connected_components(likely).select(F.col("node").alias("doc_id"), F.col("label").alias("lead")), "likely")
    # texts meet their tiles last: only ids and sizes are dealt, and a text is shuffled once
    dealt = tiles(part.join(one.select(F.col("doc").alias("doc_id"), "n"), "doc_id").withColumnRenamed("doc_id", "doc"), num, den, TEXT_TILE)
    dealt = stage_table(dealt.withColumnRenamed("doc", "doc_id"), "dealt")
    texts = known.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt, "doc_id").withColumnRenamed("doc_id", "doc")
    members = signed.select("doc_id", "n", "d1", "d2").join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"], "left")
    members = members.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    sizes = dealt.groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return members, texts, not sizes.where("least < most").isEmpty()


def _all_links(texts: DataFrame, again: bool, k: int, num: int, den: int) -> DataFrame:
    links = texts.groupBy(*TILE_KEY).applyInArrow(_links(k, num, den), "a long, b long, overlap long")
    return links.groupBy("a", "b").agg(F.max("overlap").alias("overlap")) if again else links


def ngram_jaccard_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Classes and links of ``docs(doc_id, text, ...)`` under Jaccard >= num/den on k-word shingles.

    Returns ``members(doc_id, n, rep)``, one row for each row of docs (rep: the smallest doc_id with the same set; itself where
    the set is empty), and ``links(a, b, overlap)``: every true link between class representatives, once, with a < b. n near copies
    of one another have n (n - 1) / 2 links, so links are not stored here; each action on them compares again.
    Null or empty texts have no shingles and link with nothing; rows without doc_id keep their size and have no rep. Rows that
    share a doc_id are one document of the graph. Other columns are ignored. An empty table gives empty tables.
    """
    members, texts, again = _dealt(docs, k, num, den)
    return members, _all_links(texts, again, k, num, den)


def ngram_jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, class_id and n_links.

    component_id is the smallest doc_id reachable by links; n_links counts the links of its class representative, that is the
    other classes whose sets are near (null without doc_id). Tiles compare all pairs and give the counts out, not the pairs.
    """
    members, texts, again = _dealt(docs, k, num, den)
    if again:
        links = stage_table(_all_links(texts, again, k, num, den), "links")
        counts = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links"))
    else:
        links = stage_table(texts.groupBy(*TILE_KEY).applyInArrow(_counts(k, num, den), "a long, b long, n long"), "links")
        counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
        links = links.where("b is not null")
    labels = connected_components(links.select("a", "b")).select(F.col("node").alias("rep"), "label")
    found = labels.join(counts.withColumnRenamed("a", "rep"), "rep")
    out = members.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"), F.col("rep").alias("class_id"), "n_links")
    return out.withColumn("n_links", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))))


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay: of each component the one of smallest doc_id.

    Rows with one doc_id and one text are copies, and one of them stays; rows without doc_id are not judged and stay. Null and empty
    texts link with nothing and stay. Other columns are kept as they are; an empty table gives no rows.
    """
    heads = ngram_jaccard_components(docs, k, num, den).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("c"))
    heads = stage_table(heads, "heads")
    once, again = (docs.join(heads.where(c).select("doc_id"), "doc_id", "left_semi") for c in ("c = 1", "c > 1"))
    return once.union(again.dropDuplicates(["doc_id", "text"])).union(docs.where("doc_id is null"))
