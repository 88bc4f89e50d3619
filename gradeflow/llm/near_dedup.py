"""Near-duplicate classes by BagMinHash signatures of weighted shingles (operator 6).

A text's bag: its runs of ``SHINGLE`` words (A-Z in lower case; a shorter text is one run) with their counts. Similarity is the
weighted Jaccard: sum of smaller counts over sum of larger ones.

Signatures: each shingle has a Poisson process on the half-line of weights, cut at 1, 2, 4, 8 ...; the process of a
cut has a rate of its width, and a point's place inside is found by halving the cut again and again (the binary digits of one
number), so that a point belongs to a text if its place is below the shingle's count. Points come in order of time, each hits one
register at random and a register keeps its earliest point; a process stops when it is later than all
registers of its text. Registers of two texts agree with a probability of exactly their weighted Jaccard.

Candidates: texts with one bag become one node. ``BANDS`` bands of ``BAND_ROWS`` registers put nodes in buckets; at similarity 0.8 two nodes
share no bucket with a probability of 3e-6. Which pairs of a bucket are compared:
1. each node with one other: of the smallest nodes of its buckets, the one that it shares most buckets with;
2. in ``PIVOT_ROUNDS`` rounds, for large buckets that still hold several components: each node outside the bucket's largest component with
   one pivot, a member of that component drawn anew in each round (of its buckets' pivots, the one it meets most often);
3. then all pairs of nodes that share a bucket and are still in different components, each in the first bucket that they share: small
   buckets many at a time, large ones block with block. Nothing is left out but pairs whose sizes rule the similarity out or fewer than
   ``LEAST_AGREE`` of whose ``REGISTERS`` registers agree (at 0.8: 4e-7 of pairs). ``exact=False`` ends before this.
Every candidate pair is verified on its whole bags. The first two make at most one pair a node and round.

Bounds: a task of step 3 holds two blocks of about ``BLOCK_ROWS`` nodes and ``BLOCK_BYTES`` of bags; its work, not its rows, grows with the
square of a group of unlike nodes. Nodes, pairs and labels are tables; bags of nodes in pairs alone are shuffled. Joins that a pivot or a large
class could make uneven have plain exchanges on both sides, which Spark splits where they are skewed.

Edge cases: a text without words has no shingles and is a class of its own; null is empty; rows that repeat are in
one class; a null doc_id never names a class unless all of the class are null; very long texts are taken whole; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .shared import discard, keep_rows, written
from .textkernel import LOWER, NOT_SPACE, U64, find_words, give_back, hash_spans, mix, slices, text_bytes, windows

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND_ROWS = 24, 4
REGISTERS = BANDS * BAND_ROWS
#: Of the registers of a pair, so many agree at least, or step 3 doesn't compare it.
LEAST_AGREE = 56
#: Rounds of pivots; nodes of a small bucket, and rows of small buckets that are compared together.
PIVOT_ROUNDS, SMALL, TOGETHER = 2, 16, 20_000
#: Nodes, and bytes of their bags, in a block of a bucket that is compared whole; nodes that are compared with a block at once.
BLOCK_ROWS, BLOCK_BYTES, STEP_ROWS = 1024, 32 << 20, 64


def bags(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of each distinct shingle of each row, in order of rows."""
    w = find_words(LOWER[raw] if len(raw) else raw, offs, NOT_SPACE)
    h, n = hash_spans(w.raw, w.starts, w.ends), w.counts
    row = w.row_of()
    found = windows(h, size)
    whole = np.arange(len(found)) + size <= w.rows[1:][row[: len(found)]] if len(found) else np.zeros(0, bool)
    rows, keys = row[: len(found)][whole], found[whole]
    for k in np.flatnonzero((n > 0) & (n < size)).tolist():  # a short text is one shingle
        rows, keys = np.append(rows, k), np.append(keys, windows(h[w.rows[k] : w.rows[k + 1]], int(n[k])) + U64(n[k]))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.diff(np.append(first, len(keys)))


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, key: np.ndarray, count: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_rows, registers) of 32-bit register values; rows without shingles have 0."""
    early = np.full(n_rows * registers, np.inf)
    ids = np.zeros(n_rows * registers, dtype=np.uint32)
    rows, seeds, rates, needs = [], [], [], []
    cut = 0
    low = 0
    while len(row):  # cuts [0, 1), [1, 2), [2, 4), [4, 8) ...
        width = 1 if cut == 0 else low
        rows.append(row)
        seeds.append(mix(key + U64(cut * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        rates.append(np.full(len(row), width, dtype=np.int64))
        needs.append(np.minimum(count - low, width))
        low += width
        more = count > low
        row, key, count, cut = row[more], key[more], count[more], cut + 1
    row, seed, rate, need = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, seeds, rates, needs))
    time, point = np.zeros(len(row)), 0
    while len(row):
        point += 1
        a = mix(seed + U64(point * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
        b = mix(a)
        time = time - np.log(_uniform(a)) / rate
        place = (b >> U64(32)).astype(np.int64) * rate >> 32  # below the width; its binary digits are the halvings
        at = row * registers + (b & U64(0xFFFFFFFF)).astype(np.int64) * registers // (1 << 32)
        on = place < need
        hit, when, who = at[on], time[on], (mix(b) >> U64(32)).astype(np.uint32)[on]
        np.minimum.at(early, hit, when)
        won = early[hit] == when
        ids[hit[won]] = who[won]
        last = early.reshape(n_rows, registers).max(axis=1)
        alive = time < last[row]
        row, seed, rate, need, time = row[alive], seed[alive], rate[alive], need[alive], time[alive]
    return ids.reshape(n_rows, registers)


def _elements(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A bag as a set: one element for each shingle and occurrence."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return mix(np.repeat(key, count) + nth.astype(U64) * U64(0x9E3779B97F4A7C15))


NODES = "doc_id long, text_key long, bag_a long, bag_b long, size long, sketch binary, bands array<long>, zipped binary"


def _nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw_all, offs = text_bytes(batch.column("text"))
        for a, b in slices(raw_all, offs):
            raw, own = raw_all[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            row, key, count = bags(raw, own, size)
            m = b - a
            sums = []
            for c in (1, 2):  # a bag's identity: sums of its elements' hashes
                term = mix(key * U64(2 * c + 1)) * count.astype(U64)
                total = np.concatenate([np.zeros(1, U64), np.cumsum(term, dtype=U64)])
                edges = np.searchsorted(row, np.arange(m + 1))
                sums.append((total[edges[1:]] - total[edges[:-1]]).astype(np.int64))
            sig = signatures(row, key, count, m).astype(U64)
            some = np.diff(edges) > 0
            h = np.zeros((m, BANDS), U64)
            for k in range(BAND_ROWS):
                h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, k::BAND_ROWS] + np.arange(BANDS, dtype=U64) * U64(1 << 33))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(h[some].ravel().astype(np.int64)))
            size_of = np.bincount(row, count, m).astype(np.int64)
            sketch = [x.tobytes() for x in sig.astype(np.uint8)]  # a byte of each register
            data = raw.tobytes()
            zipped = [tool.compress(data[x:y]) for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, m), batch.column("text_key").slice(a, m), *(pa.array(x) for x in sums), pa.array(size_of), pa.array(sketch, pa.binary()), bands, pa.array(zipped, pa.binary())], names=["doc_id", "text_key", "bag_a", "bag_b", "size", "sketch", "bands", "zipped"])


def _elements_of(nodes: DataFrame, size: int) -> DataFrame:
    """(node, bag: sorted elements as bytes)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [tool.decompress(x.as_py()) for x in part.column("zipped")]
                offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                row, key, count = bags(np.frombuffer(b"".join(texts), np.uint8), offs, size)
                edges = np.searchsorted(row, np.arange(part.num_rows + 1))
                out = [np.sort(_elements(key[x:y], count[x:y])).tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(out, pa.binary())], names=["node", "bag"])

    return nodes.select("node", "zipped").mapInArrow(lambda it: give_back(expand(it)), "node long, bag binary")


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two bags of sorted elements are similar enough."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
        return False
    z = np.concatenate([x, y])
    z.sort(kind="stable")
    both = int((z[1:] == z[:-1]).sum())
    return both >= threshold * (len(z) - both) - 1e-9


def _bags_of(wanted: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """(node, bag) of the nodes of ``wanted``."""
    return written(_elements_of(table.withColumnRenamed("uid", "node").join(wanted.select("node").distinct(), "node", "left_semi"), size), "bags")


def _verified(pairs: DataFrame, table: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose bags are similar enough. pairs: written."""
    held = _bags_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), table, size)
    of = lambda c: held.select(F.col("node").alias(c), F.col("bag").alias(f"bag_{c}"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), threshold) for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    out = written(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "bag_a", "bag_b").mapInArrow(lambda it: give_back(verify(it)), "a long, b long"), "links")
    discard(held)
    return out


def _may_be(size_a: Column, size_b: Column, threshold: float) -> Column:
    """Sizes that allow the similarity."""
    return F.least(size_a, size_b) >= threshold * F.greatest(size_a, size_b) - 1e-9


def _star(filled: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each node b with the smallest node a of most of its buckets."""
    rows = filled.filter((F.col("rep") != F.col("node")) & _may_be(F.col("size"), F.col("rep_size"), threshold))
    return written(rows.groupBy(F.col("node").alias("b")).agg(F.mode("rep", True).alias("a")).select("a", "b"), "pairs")


def _apart(filled: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, node, size, n, comp) of the buckets that hold several components."""
    rows = filled.join(labels, "node", "left").select("bucket", "node", "size", "n", F.coalesce("comp", "node").alias("comp"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("bucket")
    return written(rows.join(mixed, "bucket"), "apart")


def _pivots(apart: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(a, b): each node b outside its buckets' largest components with a pivot a of one of these."""
    drawn = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "size")).alias("y")
    comps = apart.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"), drawn)
    main = comps.groupBy("bucket").agg(F.max(F.struct("m", "comp", "y")).alias("top")).select("bucket", F.col("top.comp").alias("main"), F.col("top.y.node").alias("a"), F.col("top.y.size").alias("pivot_size"))
    rows = apart.join(main, "bucket").filter((F.col("comp") != F.col("main")) & _may_be(F.col("size"), F.col("pivot_size"), threshold))
    return written(rows.groupBy(F.col("node").alias("b")).agg(F.mode("a", True).alias("a")).select("a", "b"), "pairs")


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(node, comp, size, (rows, REGISTERS) sketches, (BANDS, rows) buckets) of a group's rows."""
    node, comp, size = (table.column(c).to_numpy() for c in ("node", "comp", "size"))
    sketch = np.frombuffer(b"".join(x.as_py() for x in table.column("sketch")), np.uint8).reshape(-1, REGISTERS)
    bands = np.ascontiguousarray(table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS).T)
    return node, comp, size, sketch, bands


def _small_pairs(table: pa.Table, threshold: float) -> pa.Table:
    """All pairs of many small buckets that may be similar, are apart and share no earlier bucket."""
    bucket = table.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket, (node, comp, size, sketch, bands) = bucket[order], _columns(table.take(pa.array(order)))
    where = (bands == bucket[None]).argmax(axis=0)  # which band the bucket is of
    found = [(node[:0], node[:0])]
    x = np.arange(len(bucket))
    for step in range(1, SMALL):
        x = x[x + step < len(bucket)]
        x = x[bucket[x] == bucket[x + step]]
        y = x + step
        on = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9)
        p, q = x[on], y[on]
        on = (sketch[p] == sketch[q]).sum(axis=1) >= LEAST_AGREE
        p, q = p[on], q[on]
        same = bands[:, p] == bands[:, q]
        on = same.argmax(axis=0) == where[p]
        found.append((node[p[on]], node[q[on]]))
    a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


GROUP = ["bucket", "i", "j"]


def _open_pairs(table: pa.Table, threshold: float) -> pa.Table:
    """All pairs of blocks i and j of one bucket that may be similar, are apart and share no earlier bucket."""
    bucket, i, j = (table.column(c)[0].as_py() for c in GROUP)
    own = table.column("own").to_numpy()
    node, comp, size, sketch, bands = _columns(table)
    at = int(np.flatnonzero(bands[:, 0] == bucket)[0])
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = []
    for k in range(0, len(left), STEP_ROWS):
        x = left[k : k + STEP_ROWS]
        agree = np.zeros((len(x), len(right)), np.uint8)
        for r in range(REGISTERS):
            agree += sketch[x, r][:, None] == sketch[right, r][None]
        ok = (agree >= LEAST_AGREE) & (comp[x][:, None] != comp[right][None])
        for b in range(at):
            ok &= bands[b][x][:, None] != bands[b][right][None]
        small, large = np.minimum(size[x][:, None], size[right][None]), np.maximum(size[x][:, None], size[right][None])
        ok &= small >= threshold * large - 1e-9
        if i == j:
            ok &= node[x][:, None] < node[right][None]
        a, b = np.nonzero(ok)
        found.append((node[x[a]], node[right[b]]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    n = 1 if len(a) else 0
    keys = [pa.array([x] * n, t) for x, t in ((bucket, pa.int64()), (i, pa.int64()), (j, pa.int64()))]
    return pa.table([*keys, *(pa.array([x.astype("<i8").tobytes()] * n, pa.binary()) for x in (a, b))], names=[*GROUP, "a", "b"])


def _of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, i, j, node) of the nodes of packed pairs."""
    for batch in batches:
        for r in batch.to_pylist():
            node = np.unique(np.frombuffer(r["a"] + r["b"], "<i8"))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(node), r[c], np.int64)) for c in GROUP), pa.array(node)], names=[*GROUP, "node"])


def _links_of(packed: pa.Table, held: pa.Table, threshold: float) -> pa.Table:
    """Similar pairs of one group of packed pairs; pairs that its links already join are left out."""
    node = held.column("node").to_numpy()
    bag = [np.frombuffer(x.as_buffer(), "<u8") for x in held.column("bag")]
    order = np.argsort(node)
    up, links = list(range(len(node))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for p, q in zip(packed.column("a"), packed.column("b"), strict=True):
        a, b = (order[np.searchsorted(node, np.frombuffer(z.as_buffer(), "<i8"), sorter=order)].tolist() for z in (p, q))
        for x, y in zip(a, b, strict=True):
            if (r := root(x)) != (s := root(y)) and _similar(bag[x], bag[y], threshold):
                up[r] = s
                links.append((node[x], node[y]))
    return pa.table([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])


def _small_rest(apart: DataFrame, table: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) among all pairs of different components in small buckets."""
    rows = apart.filter(F.col("n") <= SMALL)
    parts = max(1, -(-rows.count() // TOGETHER))
    rows = rows.join(table.select(F.col("uid").alias("node"), "sketch", "bands"), "node").withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(parts)))
    pairs = rows.groupBy("part").applyInArrow(lambda t: _small_pairs(t, threshold), "a long, b long")
    return _verified(written(pairs.distinct(), "pairs"), table, threshold, size)


def _large_rest(apart: DataFrame, table: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) among all pairs of different components in large buckets."""
    large = apart.filter(F.col("n") > SMALL)
    of_bucket = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("sum"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("sum") * 8 / BLOCK_BYTES))
    cut = large.join(of_bucket.select("bucket", blocks.alias("blocks")), "bucket")
    dealt = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), "blocks")).join(table.select(F.col("uid").alias("node"), "sketch", "bands"), "node")
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "size", "comp", "sketch", "bands", "own")
    packed = written(sent.groupBy(*GROUP).applyInArrow(lambda t: _open_pairs(t, threshold), "bucket long, i long, j long, a binary, b binary"), "packed")
    wanted = written(packed.mapInArrow(_of_pairs, "bucket long, i long, j long, node long"), "wanted")
    of_group = wanted.join(_bags_of(wanted, table, size), "node")
    return written(packed.groupBy(*GROUP).cogroup(of_group.groupBy(*GROUP)).applyInArrow(lambda x, y: _links_of(x, y, threshold), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, exact: bool = True) -> DataFrame:
    """(doc_id, class_id: smallest doc_id of the class, class_size, kept, text_key) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    table = written(rows.mapInArrow(lambda it: give_back(_nodes(it, size)), NODES).withColumn("uid", F.monotonically_increasing_id()), "bag-nodes")
    shingled = table.filter(F.size("bands") > 0)
    first = shingled.groupBy("bag_a", "bag_b").agg(F.min("uid").alias("node"))
    members = written(shingled.select("uid", "bag_a", "bag_b").join(first, ["bag_a", "bag_b"]).select("uid", "node"), "members")
    entries = table.select("uid", "size", "bands").join(members.filter("uid = node"), "uid").select("node", "size", F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("rep")).filter("n > 1")
    filled = written(entries.join(buckets, "bucket").select("bucket", "node", "size", "n", F.col("rep.node").alias("rep"), F.col("rep.size").alias("rep_size")), "buckets")
    labels = components(_verified(_star(filled, threshold), table, threshold, size))
    apart = None
    for turn in range(PIVOT_ROUNDS):
        if apart is None:
            apart = _apart(filled.filter(F.col("n") > SMALL), labels)
        pairs = _pivots(apart, turn, threshold)
        if pairs.isEmpty():
            break
        before, labels = labels, joined(labels, _verified(pairs, table, threshold, size))
        apart = apart if labels is before else None
    if exact:
        apart = _apart(filled, labels)
        labels = joined(labels, _small_rest(apart, table, threshold, size).unionByName(_large_rest(apart, table, threshold, size)))
    placed = table.select("uid", "doc_id", "text_key").join(members, "uid", "left").join(labels, "node", "left").select("uid", "doc_id", "text_key", F.coalesce("comp", "node", "uid").alias("comp"))
    placed = written(placed, "placed")
    named = placed.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("low"))
    out = placed.join(written(named, "classes"), "comp")
    return out.select("doc_id", "class_id", "class_size", (F.col("uid") == F.col("low.uid")).alias("kept"), "text_key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class."""
    return keep_rows(docs, near_duplicates(docs, threshold).select("doc_id", "text_key", "kept"), F.xxhash64(docs["text"].cast("string")))
