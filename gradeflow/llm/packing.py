"""Best-fit packing with certified bin counts (operator 8).

Documents become token ids with one end id; those longer than a sequence are cut from the end into full
pieces, so only the first piece may be shorter. Full pieces are sequences of their own. All others are packed by
best-fit decreasing within partitions of about ``PART_ROWS`` pieces. For each partition
dual-feasible functions of the piece lengths give a lower bound of its bins. A partition that
meets its bound is certified: it keeps all but its emptiest bin. Any other keeps its (nearly) full bins. The documents
of the rest change partitions and are packed anew, until they fit one partition or ``MAX_ROUNDS`` are over;
a round that needs no fewer bins than before is dropped and the former bins stay. ``gap`` tells how many sequences there are
above the lower bound of all pieces together.

Pieces are dealt by a hash of a row number that is written with them, so neither a hot key nor repeated rows
gather in one partition. Lengths, not texts, are shuffled.

Edge cases: null and empty texts are one end id; an empty table gives no rows; rows that repeat are each packed;
a null ``doc_id`` is carried along; other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import written
from .textkernel import give_back, slices, text_bytes

SEQUENCE, END_ID = 2048, 0
#: Pieces of one partition; rounds of exchange; free tokens of a bin that counts as full.
PART_ROWS, MAX_ROUNDS, SLACK = 50_000, 4, 2

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids."""
    return ([n % size] if n % size else []) + [size] * (n // size)


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = bpe.encoder(tokenizer)
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            names = batch.column("doc_id")
            for a, b in slices(raw, offs):
                ids, at = tool.batch(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                row, part, start, length, crc = [], [], [], [], []
                ids = ids.astype("<u4")
                for k in range(b - a):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))
                    begin = 0
                    for p, n in enumerate(cut(len(own), size)):
                        row.append(a + k)
                        part.append(p)
                        start.append(begin)
                        length.append(n)
                        crc.append(zlib.crc32(own[begin : begin + n].tobytes()))
                        begin += n
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row, pa.int64())), pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tool.clear()  # a reused worker keeps no chunks

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: give_back(encode(it)), PIECE)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Least bins for pieces of these lengths."""
    return bound_of_counts(np.bincount(lengths, minlength=size + 1).astype(np.int64), size)


def bound_of_counts(count: np.ndarray, size: int) -> int:
    """Least bins, for the number of pieces of each length, by dual-feasible functions: the volume; thresholds that round long pieces up to a
    bin, keep middle ones and drop short ones; and rounding down to multiples of 1/k."""
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // size)
    many, volume = np.cumsum(count), np.cumsum(count * x)
    for t in range(0, size // 2 + 1):  # longer than size - t: 1; from t to size - t: as they are; shorter: 0
        whole = int(many[size] - many[size - t])
        middle = int(volume[size - t] - (volume[t - 1] if t else 0))
        best = max(best, whole + -(-middle // size))
    for k in range(2, 33):  # x/size -> floor((k+1) x/size)/k, but exact where (k+1) x/size is whole
        f = np.where((k + 1) * x % size == 0, (k * x) // 1, ((k + 1) * x // size) * size)
        best = max(best, -(-int((count * f).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its offset there, fill of each bin). Free space is a bit set, so the best fit is a bit scan."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    open_bits = 0
    for k, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = open_bits >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_bits ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += n
        if room > n:
            free[room - n].append(b)
            open_bits |= 1 << (room - n)
    return bins, offsets, np.array(fills, dtype=np.int64)


PLACED = "uid long, length long, part int, bin long, offset long, keeps boolean, bound long, bins long"


def _pack(rows: DataFrame, n_parts: int, turn: int, size: int) -> DataFrame:
    """Packs each partition by itself; ``keeps``: the piece's bin is final."""

    def one(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, size)
        bound = lower_bound(lengths, size)
        closed = fills >= size - SLACK
        if len(fills) == bound:
            closed[:] = True
            closed[np.argmin(fills)] = fills.min() >= size - SLACK
        same = lambda x: pa.array(np.full(len(lengths), x, dtype=np.int64))
        return pa.table([table.column("uid"), table.column("length"), table.column("part"), pa.array(bins), pa.array(offsets), pa.array(closed[bins]), same(bound), same(len(fills))], names=["uid", "length", "part", "bin", "offset", "keeps", "bound", "bins"])

    part = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(n_parts)).cast("int")
    return rows.select("uid", "length", part.alias("part")).groupBy("part").applyInArrow(one, PLACED)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, part_rows: int = PART_ROWS) -> DataFrame:
    """Every piece with its sequence and offset, and whether its sequence's partition was certified."""
    cuts = written(pieces(docs, tokenizer, size, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rest = cuts.filter(F.col("length") < size).select("uid", "length")
    n = rest.count()
    final: list[DataFrame] = []
    before: DataFrame | None = None
    bins_before = 0
    for turn in range(MAX_ROUNDS):
        if not n:
            break
        n_parts = math.ceil(n / part_rows)
        # placements are 40 bytes a piece: written, so that each round reads the last one's as they were
        placed = written(_pack(rest, n_parts, turn, size).withColumn("turn", F.lit(turn)), f"packed-{turn}")
        bins = placed.groupBy("part").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if before is not None and bins >= bins_before:
            final.append(before)
            before = None
            break
        final.append(placed.filter("keeps"))
        before, rest = placed.filter(~F.col("keeps")), placed.filter(~F.col("keeps")).select("uid", "length")
        n, bins_before = before.agg(F.count(F.lit(1)), F.count_distinct("part", "bin")).first()
        if n_parts == 1:
            break
    if before is not None:
        final.append(before)
    places = None
    for f in final:
        f = f.select("uid", (F.col("turn") * F.lit(1 << 55) + F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified"))
        places = f if places is None else places.unionByName(f)
    whole = cuts.filter(F.col("length") == size).withColumns({"sequence_id": F.lit(1 << 60) + F.col("uid"), "offset": F.lit(0).cast("long"), "certified": F.lit(True)})
    if places is not None:
        whole = whole.unionByName(cuts.filter(F.col("length") < size).join(places, "uid"))
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def gap(packed: DataFrame, size: int = SEQUENCE) -> tuple[int, int]:
    """(sequences, lower bound of all pieces together): equal if the packing is certified as a whole."""
    counts = packed.groupBy("length").count().collect()  # a row for each length: ``size`` at most
    by_length = np.zeros(size + 1, np.int64)
    for r in counts:
        by_length[r.length] = r["count"]
    return packed.agg(F.count_distinct("sequence_id")).first()[0], bound_of_counts(by_length, size)
