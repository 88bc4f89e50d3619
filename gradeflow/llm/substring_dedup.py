"""Removal of repeated passages by level-wise doubling (operator 3).

Sizes of windows double from ``START`` words until the next one would reach the size asked for, which is the last (``levels``). The
first level's candidates are all windows of its size; those of each other level are the windows whose anchor, the smallest by hash among
the windows of the size before inside them, is repeated. Windows repeated at one size alone are so extended to the next, until a level
finds none repeated (then nothing is removed) or the last size is reached, whose repeated windows are removed.

Below the last size only anchors are looked at: windows that are the smallest in some window of the next size. Equal windows have
equal anchors, so none is lost, and one in some 13 remains.

Texts are written once to the shared folder, bucketed by a key of their row, and are not shuffled again: at each level a task
compares the windows of its own rows; what it finds repeated is settled there, and of equal windows only those of its smallest doc_id are
sent on, in sorted packets by part of the hash space. So a passage in a third of all rows costs one entry a key, and no group is ever
gathered. A part's answers go back as one packet for each key of rows, which meets the key's texts without moving them.

Windows are known by 64 bits of hash, and by 32 more bits at the last size.

Edge cases: a null text has no words; texts under ``window`` words lose nothing; equal windows under the same
doc_id (also in rows that repeat it) don't count as repeated by themselves; a null doc_id counts as larger than all others, and such rows
as one document; very long texts are slices of their own; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, discard, parts_bits, written
from .textkernel import NOT_SPACE, U64, extremes, find_words, hash_spans, ragged, slices, text_bytes, windows

#: Words of a window that is removed; most words of the first level's windows.
WINDOW, START = 50, 25
#: Bytes of text whose windows make one part of the hash space, and whose rows make one key; most bits of either.
PART_BYTES, MOST_BITS = 4 << 20, 20
#: Bytes of text whose windows the first level compares before it sends them.
FLUSH_BYTES = 24 << 20
MOST = U64((1 << 64) - 1)

PACKET = "part int, ids binary, rids binary, keys binary, checks binary, docs binary, places binary"
FOUND = "key int, ids binary, rids binary, counts binary, places binary"


def levels(window: int, start: int = START) -> list[int]:
    """Sizes of windows, doubling; the last is ``window``."""
    out = [max(1, min(start, (window + 1) // 2))]
    while 2 * out[-1] < window:
        out.append(2 * out[-1])
    return out if out[-1] == window else [*out, window]


def _texts(docs: DataFrame, bits: int) -> DataFrame:
    """(key, doc_id, id, rid, text) of every row, bucketed by key: the upper bits of rid.

    rid tells rows with one doc_id but different texts apart; its lowest bit is set where doc_id is null (and id is 0).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rid = F.xxhash64("doc_id", "text")
    rid = F.when(F.col("doc_id").isNull(), rid.bitwiseOR(F.lit(1))).otherwise(rid.bitwiseAND(F.lit(-2)))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), rid.alias("rid"), "text")
    return bucketed(rows.select(F.shiftrightunsigned("rid", 64 - bits).cast("int").alias("key"), "*"), "key", 1 << bits, "passages")


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, rows' first words)."""
    w = find_words(raw, offs, NOT_SPACE)
    return hash_spans(raw, w.starts, w.ends), w.row_of(), w.rows


def _whole(row: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Whether a window of ``size`` words starts at each word."""
    return np.arange(len(row)) + size <= rows[1:][row] if len(row) else np.zeros(0, bool)


def _windows_of(h: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
    """Hash of the window at each word; the largest value where a row has none."""
    out = np.full(len(h), MOST, dtype=U64)
    found = windows(h, size)
    at = np.flatnonzero(whole)
    out[at] = np.minimum(found[at], MOST - U64(1))
    return out


def _smallest(short: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """For each long window that is there: the smallest of its ``span`` short ones; 0 elsewhere."""
    out = np.zeros(len(short), dtype=U64)
    if len(short) >= span:
        low = extremes(short, span, np.minimum)
        out[: len(low)] = np.where(whole[: len(low)], low, 0)
    return out


def _anchors(short: np.ndarray, whole: np.ndarray, span: int) -> np.ndarray:
    """Whether each short window is the smallest in some long one."""
    low = _smallest(short, whole, span)
    high = extremes(np.concatenate([np.zeros(span - 1, U64), low]), span, np.maximum)
    return (high == short) & (short != MOST)


def candidates(raw: np.ndarray, offs: np.ndarray, sizes: list[int], k: int, repeated: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(hashes, checks, rows, places) of level ``k``'s candidates; ``repeated``: words at which the level before has a repeated window."""
    h, row, rows = _words(raw, offs)
    whole = _whole(row, rows, sizes[k])
    own = _windows_of(h, whole, sizes[k])
    on = whole.copy()
    if k:
        span, short = sizes[k] - sizes[k - 1] + 1, _windows_of(h, _whole(row, rows, sizes[k - 1]), sizes[k - 1])
        known = np.full(len(short), MOST, dtype=U64)
        known[repeated] = short[repeated]
        low = _smallest(short, whole, span)
        on &= (_smallest(known, whole, span) == low) & (low != MOST)
    last = k == len(sizes) - 1
    if not last:
        on &= _anchors(own, _whole(row, rows, sizes[k + 1]), sizes[k + 1] - sizes[k] + 1)
    at = np.flatnonzero(on)
    checks = (windows(h * U64(0xC2B2AE3D27D4EB4F) + U64(1), sizes[k])[at] >> U64(32)).astype(np.uint32) if last and len(at) else np.zeros(len(at), np.uint32)
    return own[at], checks, row[at], (at - rows[:-1][row[at]]).astype(np.uint32)


def _ranks(ids: np.ndarray, rids: np.ndarray) -> np.ndarray:
    """Numbers of documents in order of doc_id, null last; equal for equal ones."""
    null = rids & 1
    order = np.lexsort((ids, null))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (null[order][1:] != null[order][:-1])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def compare(doc: np.ndarray, keys: np.ndarray, checks: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(entries known to be repeated, entries of the smallest document of each window).

    Repeated are windows with a smaller document; with ``both`` also the smallest's own, if there is another.
    """
    order = np.lexsort((doc, checks, keys))
    k, c, d = keys[order], checks[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    least = d[new]
    above = d > least[group]
    many = np.zeros(len(least), bool)
    many[group[above]] = True
    return order[many[group] if both else above], order[~above]


class _Sender:
    """Windows of several rows: settles what is repeated among them, and packs the rest."""

    def __init__(self, both: bool, bits: int) -> None:
        self.both, self.bits = both, bits
        self._new()

    def _new(self) -> None:
        self.held, self.n_docs, self.n = [], 0, 0

    def add(self, ids: np.ndarray, rids: np.ndarray, keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray) -> None:
        self.held.append((ids, rids, keys, checks, docs + self.n_docs, places))
        self.n_docs += len(ids)
        self.n += len(keys)

    def packets(self) -> pa.Table:
        """One row for each part of the hash space; places settled here go along without keys, each document's to one part."""
        ids, rids, keys, checks, docs, places = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.n else [np.zeros(0, np.int64)] * 6
        self._new()
        settled, sent = compare(_ranks(ids, rids)[docs], keys, checks, self.both)
        shift, rows = U64(64 - self.bits), []
        for at, part, keyed in ((sent, (keys[sent].astype(U64) >> shift).astype(np.int64), True), (settled, (rids[docs[settled]].astype(U64) >> shift).astype(np.int64), False)):
            order = np.lexsort((docs[at], part))
            at, part = at[order], part[order]
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x = at[a:b]
                used, d = np.unique(docs[x], return_inverse=True)
                hashes = (keys[x].astype("<u8").tobytes(), checks[x].astype("<u4").tobytes()) if keyed else (b"", b"")
                rows.append((int(part[a]), ids[used].astype("<i8").tobytes(), rids[used].astype("<i8").tobytes(), *hashes, d.astype("<u4").tobytes(), places[x].astype("<u4").tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["part", "ids", "rids", "keys", "checks", "docs", "places"])


def _rows_of(part) -> tuple[np.ndarray, np.ndarray]:
    """(id, rid) of a batch's or table's rows."""
    return tuple(part.column(c).to_numpy() for c in ("id", "rid"))


def _first(batches: Iterator[pa.RecordBatch], sizes: list[int], bits: int, flush: int) -> Iterator[pa.RecordBatch]:
    held, size = _Sender(len(sizes) > 1, bits), 0
    for batch in batches:
        raw, offs = text_bytes(batch.column("text"))
        for a, b in slices(raw, offs):
            keys, checks, row, places = candidates(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a], sizes, 0, None)
            held.add(*_rows_of(batch.slice(a, b - a)), keys, checks, row, places)
            size += int(offs[b] - offs[a])
            if size >= flush:
                yield from held.packets().to_batches()
                size = 0
    yield from held.packets().to_batches()


def _places_of(found: pa.Table, ids: np.ndarray, rids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the found places of rows, in order of rows."""
    of = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in found.column(c)])
    if not found.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts, place = of("counts", "<u4"), of("places", "<u4").astype(np.int64)
    rid, own = np.repeat(of("rids", "<i8"), counts), np.repeat(of("ids", "<i8"), counts)
    order = np.argsort(rid, kind="stable")
    rid, own, place = rid[order], own[order], place[order]
    low = np.searchsorted(rid, rids)
    size = np.searchsorted(rid, rids, "right") - low
    row, at = np.repeat(np.arange(len(rids)), size), ragged(low, size)
    same = own[at] == ids[row]
    return row[same], place[at[same]]


def _next(texts: pa.Table, found: pa.Table, sizes: list[int], k: int, bits: int) -> pa.Table:
    """Level ``k``'s packets of one key's rows."""
    ids, rids = _rows_of(texts)
    row, place = _places_of(found, ids, rids)
    held = _Sender(k < len(sizes) - 1, bits)
    raw, offs = text_bytes(texts.column("text"))
    for a, b in slices(raw, offs) if len(row) else ():
        x, y = np.searchsorted(row, [a, b])
        if x < y:
            own, edges = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            at = place[x:y] + find_words(own, edges, NOT_SPACE).rows[row[x:y] - a]
            held.add(ids[a:b], rids[a:b], *candidates(own, edges, sizes, k, at))
    return held.packets()


def _settled(packets: DataFrame, both: bool, key_bits: int) -> DataFrame:
    """Every part's answers, as packets for the keys of rows."""
    return packets.groupBy("part").applyInArrow(lambda table: _settle(table, both, key_bits), FOUND)


def _settle(table: pa.Table, both: bool, key_bits: int) -> pa.Table:
    """One part of the hash space: places of repeated windows, a packet for each key of rows."""
    of = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]
    ids, rids, keys, checks, docs, places = of("ids", "<i8"), of("rids", "<i8"), of("keys", "<u8"), of("checks", "<u4"), of("docs", "<u4"), of("places", "<u4")
    first = np.cumsum([0, *map(len, ids)])
    docs = [d.astype(np.int64) + n for d, n in zip(docs, first, strict=False)]
    open_ = [k for k in range(len(keys)) if len(keys[k])]
    done = [k for k in range(len(keys)) if not len(keys[k])]
    join = lambda xs, which, kind: np.concatenate([np.zeros(0, kind), *(xs[k] for k in which)])
    ids, rids = np.concatenate(ids), np.concatenate(rids)
    doc, place = join(docs, open_, np.int64), join(places, open_, np.uint32)
    found, _ = compare(_ranks(ids, rids)[doc], join(keys, open_, U64), join(checks, open_, np.uint32), both)
    doc, place = np.concatenate([doc[found], join(docs, done, np.int64)]), np.concatenate([place[found], join(places, done, np.uint32)])
    key = (rids[doc].astype(U64) >> U64(64 - key_bits)).astype(np.int64)
    order = np.lexsort((place, rids[doc], key))
    key, doc, place = key[order], doc[order], place[order]
    rows, edges = [], np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at = np.flatnonzero(np.concatenate([[True], doc[a + 1 : b] != doc[a : b - 1]]))
        who, counts = doc[a:b][at], np.diff(np.append(at, b - a))
        rows.append((int(key[a]), ids[who].astype("<i8").tobytes(), rids[who].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), place[a:b].astype("<u4").tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["key", "ids", "rids", "counts", "places"])


def _beside(texts: DataFrame, found: DataFrame, use, schema: str) -> DataFrame:
    """``use(texts, found)`` of every key that has texts."""
    return texts.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(lambda x, y: use(x, y), schema)


def repeated_windows(texts: DataFrame, sizes: list[int], bits: int, flush: int = FLUSH_BYTES) -> DataFrame | None:
    """Packets of the places of windows of the last size that also start under a smaller doc_id; None if a level finds none repeated."""
    found = None
    for k in range(len(sizes)):
        if found is None:
            packets = texts.mapInArrow(lambda it: _first(it, sizes, bits, flush), PACKET)
        else:
            packets = _beside(texts, found, lambda x, y, k=k: _next(x, y, sizes, k, bits), PACKET)
        before, found = found, written(_settled(packets, k < len(sizes) - 1, bits), f"passages-{sizes[k]}")
        if before is not None:
            discard(before)
        if found.isEmpty():
            return None
    return found


def covered(places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, np.minimum(places + size, n), -1)
    return np.cumsum(change[:n]) > 0


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def _removed(texts, row: np.ndarray, place: np.ndarray, window: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """The result's rows for a batch or table of texts; row, place: of windows to remove."""
    raw_all, offs = text_bytes(texts.column("text"))
    doc_id = texts.column("doc_id")
    doc_id = doc_id.combine_chunks() if isinstance(doc_id, pa.ChunkedArray) else doc_id
    for a, b in slices(raw_all, offs):
        w = find_words(raw_all[offs[a] : offs[b]], offs[a : b + 1] - offs[a], NOT_SPACE)
        x, y = np.searchsorted(row, [a, b])
        # windows never reach beyond their row, so all rows of a slice are covered at once
        gone = covered(place[x:y] + w.rows[row[x:y] - a], len(w.starts), window)
        of = w.row_of()
        text, edges = _joined(w, ~gone, of, b - a)
        texts_kept = [text[p:q] for p, q in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        columns = [doc_id.slice(a, b - a), pa.array(w.counts.astype(np.int64)), pa.array(np.bincount(of[gone], minlength=b - a).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts_kept])]
        if keep_text:
            columns.append(pa.array([t.decode() for t in texts_kept], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=[*NAMES, *["kept_text"] * keep_text])


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, start: int = START) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and with ``keep_text`` kept_text."""
    bits = parts_bits(docs, PART_BYTES, MOST_BITS)
    texts = _texts(docs, bits)
    found = repeated_windows(texts, levels(window, start), bits)
    schema = OUT + (", kept_text string" if keep_text else "")
    if found is None:
        none = np.zeros(0, np.int64)
        return texts.mapInArrow(lambda it: (out for batch in it for out in _removed(batch, none, none, window, keep_text)), schema)

    def remove(rows: pa.Table, places: pa.Table) -> pa.Table:
        out = list(_removed(rows, *_places_of(places, *_rows_of(rows)), window, keep_text))
        return pa.Table.from_batches(out) if out else pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *[("kept_text", pa.string())] * keep_text]).empty_table()

    return _beside(texts, found, remove, schema)


def _joined(w, kept: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[bytes, np.ndarray]:
    """Kept words joined by one blank, all rows in a row, and the rows' edges in that."""
    starts, sizes, own = w.starts[kept], (w.ends - w.starts)[kept], row[kept]
    first = np.ones(len(own), dtype=bool)
    first[1:] = own[1:] != own[:-1]
    wide = sizes + ~first  # a blank before all but a row's first word
    out = np.full(int(wide.sum()), 0x20, dtype=np.uint8)
    at = np.cumsum(wide) - sizes
    out[ragged(at, sizes)] = w.raw[ragged(starts, sizes)]
    return out.tobytes(), np.concatenate([[0], np.cumsum(np.bincount(own, wide, n_rows).astype(np.int64))])
