"""Removal of repeated byte strings, by a sparse suffix array over range-partitioned buckets.

Every string of LENGTH bytes (a window) has one anchor: of the GRAM-byte strings in it, the one with
the least hash, leftmost first. Equal windows have equal anchors at equal places, so only suffixes
at anchors are indexed, some three in a hundred of all. An anchor's extent is the run of windows that
have it: the suffix from the anchor to the last window's end, and the bytes before the anchor.

1. Copies of whole texts are settled by a digest: all but the first go.
2. Splitters, sampled from short pieces of the texts, range-partition the suffixes by their leading bytes
   (then text and place, so a common lead fills many buckets, not one); they move in blocks, a row for each
   task and bucket. Each bucket is sorted by multikey quicksort. A suffix that shares its lead with no
   neighbour, in the bucket or across its boundary, is in no repeat.
3. The others come with their extents, and are range-partitioned and sorted by all their bytes.
   Neighbours that are equal are repeats but for the first. The extents of one anchor that differ may
   still have equal windows: they are cut to what they share with neighbours, forwards and backwards, until
   that leaves most of them as they are, and the windows left are sorted by multikey quicksort as well.
4. An anchor that lies at a boundary of buckets may go on in the next one: the different extents of such
   anchors meet once more, by anchor. Anchors that then have more than HOT different extents have their
   windows range-partitioned and sorted as rows of their own, and a bucket's last window is compared
   with the next bucket's first.
5. The spans found are united for each text, and cut out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, joined_to_groups, partitions, without, written
from .textkit import PIECE_BYTES, Texts, U64, pieces, powers, tidy

LENGTH, GRAM = 100, 32
#: Leading bytes by which suffixes are first sorted, in symbols of eight.
LEAD = 3
#: Different extents of one anchor that a task compares by itself; bounds the anchors of more, which are broadcast, as well.
HOT = 20_000
#: Windows that are sorted at once.
CHUNK = 100_000
#: Suffixes, extents and windows of a bucket, on average.
BUCKET_SUFFIXES, BUCKET_EXTENTS, BUCKET_WINDOWS = 400_000, 100_000, 200_000
#: Suffixes of a bucket, on average, that splitters are chosen from, and bytes of text of which such suffixes are taken at once.
SAMPLED, SAMPLE_BYTES = 200, 512
#: Suffixes that a task deals out to buckets at once.
DEALT = 1_000_000
SIGN = U64(1 << 63)


def extents(texts: Texts, length: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor: text, first window, number of windows, and place of the anchor."""
    data, n = texts.data, len(texts.data)
    if n < length:
        return dict.fromkeys(("doc", "at", "windows", "anchor"), np.zeros(0, np.int64))
    h = texts.prefix_hash()
    _, down = powers(n + 1)
    count = n - gram + 1
    grams = (h[gram:] - h[:count]) * down[:count]
    grams ^= grams >> U64(29)
    grams *= U64(0xBF58476D1CE4E5B9)
    grams ^= grams >> U64(32)
    bits = max(20, int(n).bit_length())
    low = U64((1 << bits) - 1)
    least = (grams & ~low) | np.arange(count, dtype=U64)  # the leftmost wins ties
    width, goal = 1, length - gram + 1
    while 2 * width <= goal:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < goal:
        least = np.minimum(least[: len(least) - (goal - width)], least[goal - width :])
    anchor = (least & low).astype(np.int64)
    sizes = np.diff(texts.offsets)
    valid = np.zeros(len(anchor) + 1, np.int32)
    real = np.flatnonzero(sizes >= length)
    valid[texts.offsets[real]] += 1
    valid[texts.offsets[real] + sizes[real] - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]])
    start = np.flatnonzero(valid & change)
    # A run lasts until the next run, or the last window of its text.
    doc = np.searchsorted(texts.offsets, start, "right") - 1
    last = texts.offsets[doc + 1] - length
    until = np.minimum(np.concatenate([start[1:], [n]]), last + 1)
    return {"doc": doc, "at": start, "windows": until - start, "anchor": anchor[start]}


# A spot is a run's place in its text in one number: first window, bytes before the anchor, windows.
def packed_spots(at: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (at << 16) | (before << 8) | windows


def unpacked_spots(spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spots >> 16, (spots >> 8) & 255, spots & 255


def _cut(column: pa.Array, length: int) -> Iterator[tuple[Texts, int]]:
    """Runs of texts and where they start in their text: very long texts come in parts that overlap by all but one byte of a window.

    A run of windows that a cut goes through becomes two extents; its windows stay the same.
    """
    for texts in pieces(column):
        if len(texts.data) <= 2 * PIECE_BYTES:
            yield texts, 0
            continue
        for at in range(0, len(texts.data) - length + 1, PIECE_BYTES):
            part = texts.data[at : at + PIECE_BYTES + length - 1]
            yield Texts(part, np.array([0, len(part)]), texts.first), at


def _keys(texts: Texts, e: dict[str, np.ndarray], ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Suffixes at anchors as rows of longs: their leading symbols in order, text and spot."""
    lead = texts.data[e["anchor"][:, None] + np.arange(8 * LEAD)]
    lead = (lead.view(">u8").astype(U64) ^ SIGN).view(np.int64)
    return np.column_stack([lead, ids, packed_spots(at, e["anchor"] - e["at"], e["windows"])])


def _sampled(length: int, gram: int, rate: float):
    """(id, text) rows to the suffixes in a share of all pieces of SAMPLE_BYTES, wherever these are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rng = np.random.default_rng(task.partitionId() if task else 0)
        for batch in batches:
            data, starts, sizes = _flat([batch], 1)
            begin = np.flatnonzero(rng.random(-(-len(data) // SAMPLE_BYTES)) < rate) * SAMPLE_BYTES
            size = np.minimum(begin + SAMPLE_BYTES, len(data)) - begin
            offsets = np.concatenate([[0], np.cumsum(size)])
            some = Texts(data[_ranges(begin, size)], offsets, 0)
            e = extents(some, length, gram)
            place = begin[e["doc"]] + e["at"] - offsets[e["doc"]]
            text = np.searchsorted(starts, place, "right") - 1
            keys = _keys(some, e, _column([batch], 0)[text], place - starts[text])
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary())], names=["rows"])

    return tidy(run)


def splitters(keys: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 rows that part the sampled rows evenly (none if there are no rows)."""
    keys = keys[np.lexsort(keys.T[::-1])]
    return keys[np.arange(1, parts) * len(keys) // parts] if len(keys) else keys


def bucket_of(keys: np.ndarray, split: np.ndarray) -> np.ndarray:
    """How many splitters are no greater than each row."""
    if not len(split):
        return np.zeros(len(keys), np.int64)
    low, high = (np.searchsorted(split[:, 0], keys[:, 0], side) for side in ("left", "right"))
    rows = np.flatnonzero(low < high)
    while len(rows):  # the first symbol doesn't tell
        middle = (low[rows] + high[rows]) // 2
        first = (split[middle] != keys[rows]).argmax(axis=1)
        below = split[middle, first] <= keys[rows, first]
        low[rows] = np.where(below, middle + 1, low[rows])
        high[rows] = np.where(below, high[rows], middle)
        rows = rows[low[rows] < high[rows]]
    return low


def _suffixes(length: int, gram: int, split: np.ndarray):
    """(id, text) rows to their suffixes at anchors, by bucket: a row has many, column by column."""

    def dealt(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(keys)
        keys.clear()
        bucket = bucket_of(rows, split)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for k in range(0, len(first), 64):
            edges = [*first[k : k + 64].tolist(), first[k + 64] if k + 64 < len(first) else len(rows)]
            blobs = [np.ascontiguousarray(rows[x:y].T).tobytes() for x, y in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first[k : k + 64]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids = _column([batch], 0).astype(np.int64)
            for texts, base in _cut(batch.column(1), length):
                e = extents(texts, length, gram)
                if not len(e["at"]):
                    continue
                keys.append(_keys(texts, e, ids[texts.first + e["doc"]], e["at"] - texts.offsets[e["doc"]] + base))
                held += len(keys[-1])
                if held >= DEALT:
                    yield from dealt(keys)
                    held = 0
        if held:
            yield from dealt(keys)

    return tidy(run)


def multikey_quicksort(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of symbols, and how many leading symbols each shares with the row before it.

    Three-way radix quicksort: a segment is parted by one symbol into rows below, equal to and above a
    pivot; the equal ones go on to the next symbol. All open segments are parted at once, a round each.
    """
    n, width = symbols.shape
    order, shared = np.arange(n), np.zeros(n, np.int64)
    start, size, depth = np.zeros(1, np.int64), np.array([n]), np.zeros(1, np.int64)
    live = size > 1 if width else np.zeros(1, bool)
    start, size, depth = start[live], size[live], depth[live]
    while len(start):
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) + np.repeat(start - first, size)
        rows = order[place]
        key = symbols[rows, np.repeat(depth, size)]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        below, above = key < pivot, key > pivot
        # Where each row goes: behind those of its segment and part that stand before it.
        n_below, n_above = np.cumsum(below), np.cumsum(above)
        base_below, base_above = n_below[first] - below[first], n_above[first] - above[first]
        last = first + size - 1
        of_below, of_above = n_below[last] - base_below, n_above[last] - base_above
        of_equal = size - of_below - of_above
        rank_below = n_below - np.repeat(base_below, size)
        rank_above = n_above - np.repeat(base_above, size)
        step = place - np.repeat(start, size)
        to = np.where(
            below, rank_below - 1,
            np.where(above, np.repeat(of_below + of_equal, size) + rank_above - 1, step - rank_below - rank_above + np.repeat(of_below, size)),
        )
        order[np.repeat(start, size) + to] = rows
        middle, high = start + of_below, start + of_below + of_equal
        shared[middle[of_below > 0]] = depth[of_below > 0]
        shared[high[of_above > 0]] = depth[of_above > 0]
        done = (depth + 1 == width) & (of_equal > 1)
        if done.any():  # equal in all symbols
            n_done = of_equal[done] - 1
            at = np.arange(n_done.sum()) + np.repeat(middle[done] + 1 - (np.cumsum(n_done) - n_done), n_done)
            shared[at] = width
        start, size, depth = (
            np.concatenate([start, middle, high]),
            np.concatenate([of_below, np.where(depth + 1 == width, 0, of_equal), of_above]),
            np.concatenate([depth, depth + 1, depth]),
        )
        live = size > 1
        start, size, depth = start[live], size[live], depth[live]
    return order, shared


def _column(batches: list[pa.RecordBatch], k: int) -> np.ndarray:
    return np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches])


def _shared_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket of suffixes to those that share their lead with a neighbour, and what lies at its boundaries.

    kind 0: shares it; 1: a first or last suffix that doesn't; 2: a first or last lead that is shared.
    """
    rows = [np.frombuffer(x.as_buffer(), np.int64).reshape(LEAD + 2, -1) for b in batches for x in b.column(1)]
    if not rows:
        return
    symbols = np.ascontiguousarray(np.concatenate(rows, axis=1).T)
    rows = None
    order, shared = multikey_quicksort(symbols[:, :LEAD])
    symbols = symbols[order]
    same = shared == LEAD
    tie = same | np.concatenate([same[1:], [False]])
    ends = np.unique([0, len(symbols) - 1])
    at = np.concatenate([np.flatnonzero(tie), ends])
    kind = np.concatenate([np.zeros(tie.sum(), np.int8), np.where(tie[ends], 2, 1).astype(np.int8)])
    for k in range(0, len(at), 1 << 16):
        some = symbols[at[k : k + (1 << 16)]]
        edge = kind[k : k + (1 << 16)] > 0
        leads = [pa.array(np.ascontiguousarray(some[:, c]), mask=~edge) for c in range(LEAD)]
        yield pa.RecordBatch.from_arrays([pa.array(kind[k : k + (1 << 16)]), pa.array(np.ascontiguousarray(some[:, LEAD])), pa.array(np.ascontiguousarray(some[:, LEAD + 1])), *leads], names=["kind", "id", "spot", *(f"l{c}" for c in range(LEAD))])


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _with_bytes(length: int):
    """Rows (id, text, spots) to their extents: the suffix from the anchor, the bytes before it, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _column([batch], 0).astype(np.int64)
            data, starts, sizes = _flat([batch], 1)
            spots = batch.column(2)
            row = np.repeat(np.arange(len(batch)), np.diff(spots.offsets.to_numpy()))
            at, before, windows = unpacked_spots(spots.flatten().to_numpy(zero_copy_only=False))
            inside = at + windows - 1 + length <= sizes[row]  # rows of one id may have different texts
            row, at, before, windows = row[inside], at[inside], before[inside], windows[inside]
            begin, after = starts[row] + at, windows - 1 + length - before
            for k in range(0, len(row), 8192):
                a, b, c = begin[k : k + 8192], before[k : k + 8192], after[k : k + 8192]
                yield pa.RecordBatch.from_arrays(
                    [_binary(data[_ranges(a + b, c)], c), _binary(data[_ranges(a, b)], b), pa.array(ids[row[k : k + 8192]]), pa.array(at[k : k + 8192].astype(np.int32))],
                    names=["after", "before", "id", "at"],
                )

    return tidy(run)


def _flat(batches: list[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary or text column of all batches, and where each row's start and how many they are."""
    data, starts, sizes, base = [], [], [], 0
    for b in batches:
        column = b.column(k)
        wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
        _, offs, own = column.buffers()
        offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        part = np.frombuffer(own, np.uint8)[offsets[0] : offsets[-1]] if own is not None else np.zeros(0, np.uint8)
        data.append(part)
        starts.append(offsets[:-1] - offsets[0] + base)
        sizes.append(np.diff(offsets))
        base += len(part)
    return np.concatenate(data), np.concatenate(starts), np.concatenate(sizes)


def _symbols(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of bytes as symbols of eight, filled up with zeros, and their sizes as the last symbol."""
    width = -(-int(sizes.max(initial=0)) // 8) * 8
    out = np.zeros((len(starts), width // 8 + 1), U64)
    steps = np.arange(width)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    for k in range(0, len(starts), 8192):
        if width:
            part = padded[starts[k : k + 8192, None] + steps]
            part[steps >= sizes[k : k + 8192, None]] = 0
            out[k : k + 8192, :-1] = part.view(">u8")
        out[k : k + 8192, -1] = sizes[k : k + 8192]
    return out


def repeated_windows(blob: np.ndarray, starts: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For windows given by their place in blob: whether an equal one stands earlier (smaller id, then place)."""
    by = np.lexsort((at, ids))  # the sort keeps the order of equal rows
    symbols = _symbols(blob, starts[by], np.full(len(starts), length))[:, :-1]
    order, shared = multikey_quicksort(symbols)
    out = np.zeros(len(starts), bool)
    order, same = by[order], shared == symbols.shape[1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out[order] = (ids[order] != ids[order[head]]) | (at[order] != at[order[head]])
    return out


SPANS = ["kind", "id", "start", "stop", "after", "before"]


def _spans(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Repeats: kind 0, without bytes."""
    none = pa.nulls(len(ids), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int8)), pa.array(ids.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), none, none], names=SPANS)


class Extents(NamedTuple):
    """Extents of several anchors (group): text, the anchor's place in it, and the bytes from it on and before it."""

    group: np.ndarray
    ids: np.ndarray
    place: np.ndarray
    after_at: np.ndarray
    ahead: np.ndarray
    before_end: np.ndarray
    behind: np.ndarray

    def take(self, rows: np.ndarray | slice) -> Extents:
        return Extents(*(x[rows] for x in self))


def most_common(symbols: np.ndarray, shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of sorted rows (group, bytes in symbols, size), the bytes that each shares at most with another one of its group: with a neighbour."""
    out = np.zeros(len(symbols), np.int64)
    width = symbols.shape[1] - 2
    if not width or len(out) < 2:
        return out
    k = np.clip(shared[1:] - 1, 0, width - 1)  # the first symbol in which they differ, or the last one
    rows = np.arange(len(k))
    differ = symbols[rows, 1 + k] ^ symbols[rows + 1, 1 + k]
    common = 8 * k + sum((differ >> U64(8 * j) == 0).astype(np.int64) for j in range(8))
    common = np.where(shared[1:] > 0, np.minimum(common, np.minimum(sizes[1:], sizes[:-1])), 0)
    out[1:] = common
    out[:-1] = np.maximum(out[:-1], common)
    return out


def narrowed(e: Extents, after: np.ndarray, before: np.ndarray, length: int) -> tuple[Extents, list[pa.RecordBatch]]:
    """Extents by group, cut to the windows that may have an equal one in another, and the spans that are found repeated on the way.

    Equal windows have their anchor at one place. So an extent's windows need no more bytes after the anchor than it
    shares with its neighbours in the order of these, and no more before it than with those in the order of the bytes
    before, read backwards. Extents that have become equal are repeats but for the first.
    """
    backwards, found = before[::-1], []
    e = e.take(np.lexsort((e.place, e.ids)))  # the sort keeps the order of equal rows
    windows = int((e.ahead + e.behind - length + 1).sum())
    while windows:
        behind = _symbols(backwards, len(before) - e.before_end, e.behind)
        group = e.group[:, None].astype(U64)
        symbols = np.concatenate([group, _symbols(after, e.after_at, e.ahead), behind], axis=1)
        order, shared = multikey_quicksort(symbols)
        same = shared == symbols.shape[1]
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        again = order[same & ((e.ids[order] != e.ids[first]) | (e.place[order] != e.place[first]))]
        found.append(_spans(e.ids[again], e.place[again] - e.behind[again], e.place[again] + e.ahead[again]))
        order, shared = order[~same], shared[~same]
        ahead = np.minimum(e.ahead[order], most_common(symbols[order, : -behind.shape[1]], shared, e.ahead[order]))
        live = ahead + e.behind[order] >= length
        by = np.argsort(order[live])
        e, behind, group = (x[order[live][by]] if x is not e else e.take(order[live][by])._replace(ahead=ahead[live][by]) for x in (e, behind, group))
        symbols = np.concatenate([group, behind], axis=1)
        order, shared = multikey_quicksort(symbols)
        least = np.zeros(len(order), np.int64)
        least[order] = np.minimum(e.behind[order], most_common(symbols[order], shared, e.behind[order]))
        e = e._replace(behind=least).take(e.ahead + least >= length)
        left = int((e.ahead + e.behind - length + 1).sum())
        if left > 0.7 * windows:
            break
        windows = left
    return e.take(np.argsort(e.group, kind="stable")), found


def _compared(length: int, gram: int, hot: int | None, chunk: int):
    """A bucket of extents to the spans that repeat (kind 0) and the extents that are to be compared elsewhere (kind 1).

    Without hot, the bucket holds all extents of its anchors, and no extent goes elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        ids, at = _column(rows, 2).astype(np.int64), _column(rows, 3).astype(np.int64)
        after, after_at, after_size = _flat(rows, 0)
        before, before_at, before_size = _flat(rows, 1)
        rows = None
        by = np.lexsort((at, ids))  # the sort keeps the order of equal rows
        symbols = np.concatenate([_symbols(after, after_at[by], after_size[by]), _symbols(before, before_at[by], before_size[by])], axis=1)
        width = symbols.shape[1]
        order, shared = multikey_quicksort(symbols)
        symbols = None
        order = by[order]
        twice = np.concatenate([[False], (shared[1:] == width) & (ids[order[1:]] == ids[order[:-1]]) & (at[order[1:]] == at[order[:-1]])])
        order, shared = order[~twice], shared[~twice]  # a row that is there twice is one row
        same = shared == width
        again = order[same]
        yield _spans(ids[again], at[again], at[again] + before_size[again] + after_size[again])
        heads, shared = order[~same], shared[~same]
        # Extents of one anchor lie together: the bucket's first and last anchor may go on in its neighbours.
        opens = np.flatnonzero(np.concatenate([[True], shared[1:] < gram // 8]))
        counts = np.diff(np.concatenate([opens, [len(heads)]]))
        apart = np.zeros(len(counts), bool)
        if hot is not None:
            apart = counts > hot
            apart[[0, -1]] = True
        elsewhere = heads[np.repeat(apart, counts)]
        for k in range(0, len(elsewhere), 1 << 14):
            some = elsewhere[k : k + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(some), np.int8)), pa.array(ids[some]), pa.array(at[some].astype(np.int32)), pa.array((at[some] + before_size[some] + after_size[some]).astype(np.int32)),
                    _binary(after[_ranges(after_at[some], after_size[some])], after_size[some]), _binary(before[_ranges(before_at[some], before_size[some])], before_size[some]),
                ],
                names=SPANS,
            )
        here = np.repeat(~apart & (counts > 1), counts)
        group = np.repeat(np.arange(len(counts)), counts)[here]
        heads = heads[here]
        e = Extents(group, ids[heads], at[heads] + before_size[heads], after_at[heads], after_size[heads], before_at[heads] + before_size[heads], before_size[heads])
        e, found = narrowed(e, after, before, length)
        yield from found
        total = np.cumsum(e.ahead + e.behind - length + 1)
        begin = 0
        while begin < len(total):
            # Whole anchors, of some `chunk` windows together.
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + chunk))
            end = int(np.searchsorted(e.group, e.group[min(end, len(total) - 1)], "right"))
            some, begin = e.take(slice(begin, end)), end
            size = some.behind + some.ahead
            blob = np.zeros(int(size.sum()), np.uint8)
            first = np.cumsum(size) - size
            blob[_ranges(first, some.behind)] = before[_ranges(some.before_end - some.behind, some.behind)]
            blob[_ranges(first + some.behind, some.ahead)] = after[_ranges(some.after_at, some.ahead)]
            windows = size - length + 1
            which, starts = np.repeat(np.arange(len(size)), windows), _ranges(first, windows)
            own_ids, own_at = some.ids[which], (some.place - some.behind)[which] + starts - first[which]
            hit = repeated_windows(blob, starts, own_ids, own_at, length)
            new = hit & ~np.concatenate([[False], hit[:-1] & (which[1:] == which[:-1])])
            end_ = hit & ~np.concatenate([hit[1:] & (which[1:] == which[:-1]), [False]])
            yield _spans(own_ids[new], own_at[new], own_at[end_] + length)

    return tidy(run)


def _windows(length: int):
    """Extents (after, before, id, start) to their windows: bytes, text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = [batch.slice(k, 1024)]
                after, after_at, after_size = _flat(part, 0)
                before, before_at, before_size = _flat(part, 1)
                size = before_size + after_size
                first = np.cumsum(size) - size
                blob = np.zeros(int(size.sum()), np.uint8)
                blob[_ranges(first, before_size)] = before[_ranges(before_at, before_size)]
                blob[_ranges(first + before_size, after_size)] = after[_ranges(after_at, after_size)]
                windows = size - length + 1
                which, starts = np.repeat(np.arange(len(size)), windows), _ranges(first, windows)
                at = _column(part, 3).astype(np.int64)[which] + starts - first[which]
                data = blob[starts[:, None] + np.arange(length)].ravel()
                yield pa.RecordBatch.from_arrays([_binary(data, np.full(len(starts), length)), pa.array(_column(part, 2)[which]), pa.array(at.astype(np.int32))], names=["w", "id", "at"])

    return tidy(run)


def _repeated(length: int):
    """A bucket of windows to those that repeat (kind 0), its first one (1) and its last one (2) with the bucket's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        task = TaskContext.get()
        ids, at = _column(rows, 1).astype(np.int64), _column(rows, 2).astype(np.int64)
        data, starts, sizes = _flat(rows, 0)
        rows = None
        symbols = np.concatenate([_symbols(data, starts, sizes)[:, :-1], ids[:, None].view(U64) ^ SIGN, at[:, None].view(U64)], axis=1)
        width = symbols.shape[1]
        order, shared = multikey_quicksort(symbols)
        symbols = None
        order, shared = order[shared < width], shared[shared < width]
        again = order[shared >= width - 2]
        chosen = np.concatenate([again, order[:1], order[-1:]])
        kind = np.concatenate([np.zeros(len(again), np.int8), np.array([1, 2], np.int8)])
        raw = [None] * len(again) + [data[starts[k] : starts[k] + length].tobytes() for k in (order[0], order[-1])]
        bucket = np.full(len(chosen), task.partitionId() if task else 0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(ids[chosen]), pa.array(at[chosen].astype(np.int32)), pa.array(bucket), pa.array(raw, pa.binary())], names=["kind", "id", "start", "bucket", "w"])

    return tidy(run)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, starts, stops) to what is left of each text."""
    for batch in batches:
        texts, starts, stops = batch.column(1), batch.column(2), batch.column(3)
        n_bytes, removed, spans, kept = [], [], [], []
        for i in range(len(batch)):
            buffer = texts[i].as_buffer() if texts[i].is_valid else None
            raw = memoryview(buffer) if buffer is not None else memoryview(b"")
            a = np.asarray(starts[i].values.to_numpy(zero_copy_only=False) if starts[i].is_valid else [], np.int64)
            b = np.asarray(stops[i].values.to_numpy(zero_copy_only=False) if stops[i].is_valid else [], np.int64)
            a, b = a[a < len(raw)], b[a < len(raw)]
            by = np.argsort(a, kind="stable")
            a, reach = a[by], np.maximum.accumulate(np.minimum(b[by], len(raw))) if len(b) else b
            new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]])) if len(a) else a
            a, reach = a[new], reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])] if len(new) else reach
            edges = np.concatenate([[0], np.stack([a, reach], 1).ravel(), [len(raw)]]).astype(np.int64)
            parts = [raw[x:y] for x, y in edges.reshape(-1, 2)]
            n_bytes.append(len(raw))
            removed.append(int((reach - a).sum()))
            spans.append(len(a))
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, chunk: int = CHUNK, buckets: int | None = None
) -> DataFrame:
    """(id, start, stop): byte spans, possibly overlapping, made of every window that also starts earlier.

    gram is a multiple of 8 from 8 * LEAD to 248 bytes, length at most gram + 200. Buckets are at least buckets (by
    default as many as shuffle partitions), and so many that they stay small.
    """
    if gram % 8 or not 8 * LEAD <= gram <= min(length, 248) or length > gram + 200:
        raise ValueError("gram must be a multiple of 8 that fits the length")
    spark = docs.sparkSession
    least = buckets or partitions(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id is not null")
    whole = own.select("id", F.octet_length("text").alias("size"), F.md5(F.encode("text", "UTF-8")).alias("digest")).filter(F.col("size") >= length)
    whole = written(whole, "suffix-whole")
    firsts = whole.groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.min("id").alias("first"), F.max("id").alias("most"), F.count("*").alias("n")).filter("first < most")
    copies = joined_to_groups(whole, firsts, {"digest": "d", "size": "s"}, "n").filter("id > first").select("id", F.lit(0).alias("start"), F.col("size").alias("stop"))
    copies = written(copies, "suffix-copies")
    texts = without(own.filter(F.octet_length("text") >= length), copies.select("id"), "id")
    total = whole.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    # Suffixes by their leading bytes; of those with a lead of their own nothing goes on.
    leads = [f"l{k}" for k in range(LEAD)]
    named = ", ".join(f"{c} long" for c in leads)
    suffixes = 2 * total // (length - gram + 2)
    parts = max(least, suffixes // BUCKET_SUFFIXES)
    sampled = texts.mapInArrow(_sampled(length, gram, SAMPLED * parts / max(1, suffixes)), "rows binary").collect()
    split = splitters(np.frombuffer(b"".join(r[0] for r in sampled), np.int64).reshape(-1, LEAD + 2), parts)
    dealt = texts.mapInArrow(_suffixes(length, gram, split), "bucket int, rows binary").repartitionById(parts, "bucket")
    ties = written(dealt.mapInArrow(tidy(_shared_leads), f"kind byte, id long, spot long, {named}"), "suffix-ties")
    dropped(whole)
    edges = ties.filter("kind > 0")
    meet = edges.groupBy(*[F.col(c).alias(f"m{c}") for c in leads]).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    across = edges.filter("kind = 1").join(meet, [F.col(c) == F.col(f"m{c}") for c in leads]).select("id", "spot")

    # The others with their extents.
    spots = ties.filter("kind = 0").select("id", "spot").union(across).groupBy(F.col("id").alias("i")).agg(F.collect_set("spot").alias("spots"))
    known = own.join(spots, F.col("id") == F.col("i")).select("id", "text", "spots")
    known = written(known.mapInArrow(_with_bytes(length), "after binary, before binary, id long, at int"), "suffix-extents")
    dropped(ties)
    parts = max(least, known.count() // BUCKET_EXTENTS)
    sorted_ = known.repartitionByRange(parts, "after", "before", "id", "at")
    found = written(sorted_.mapInArrow(_compared(length, gram, hot, chunk), "kind byte, id long, start int, stop int, after binary, before binary"), "suffix-found")
    dropped(known)

    # Anchors at boundaries once more, whole; a boundary has two, so these and the crowded ones are few.
    apart = found.filter("kind = 1").select("after", "before", "id", F.col("start").alias("at"), F.substring("after", 1, gram).alias("anchor"))
    sizes = written(apart.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("n"), F.sum(F.octet_length("after") + F.octet_length("before") - length + 1).alias("windows")), "suffix-anchors")
    crowded = F.broadcast(sizes.filter(F.col("n") > hot).select("a"))
    parts = max(least, (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // BUCKET_EXTENTS)
    rest = apart.join(crowded, F.col("anchor") == F.col("a"), "left_anti").repartition(parts, "anchor").drop("anchor")
    across = written(rest.mapInArrow(_compared(length, gram, None, chunk), "kind byte, id long, start int, stop int, after binary, before binary"), "suffix-across")

    # Crowded anchors window by window.
    parts = max(least, (sizes.filter(F.col("n") > hot).agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]) // BUCKET_WINDOWS)
    rows = apart.join(crowded, F.col("anchor") == F.col("a"), "left_semi").select("after", "before", "id", "at").mapInArrow(_windows(length), "w binary, id long, at int")
    rows = rows.repartitionByRange(parts, "w", "id", "at").mapInArrow(_repeated(length), "kind byte, id long, start int, bucket int, w binary")
    rows = written(rows, "suffix-windows")
    last = rows.filter("kind = 2").select(F.col("w").alias("lw"), F.col("bucket").alias("lb"))
    again = rows.filter("kind = 1").join(last, (F.col("w") == F.col("lw")) & (F.col("bucket") > F.col("lb")), "left_semi")
    more = rows.filter("kind = 0").select("id", "start").union(again.select("id", "start")).select("id", "start", (F.col("start") + length).alias("stop"))
    return found.filter("kind = 0").select("id", "start", "stop").union(across.select("id", "start", "stop")).union(more).union(copies)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, chunk: int = CHUNK, buckets: int | None = None
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    Every byte goes that some string of `length` bytes covers which also starts earlier: in a text of
    smaller id, or before it in the same text. Texts are compared as they are given, never across
    two of them. A null text counts as empty; texts shorter than `length` stay whole; rows without an
    id take no part and stay whole; rows that repeat an id and its text are one text and get equal results,
    and what repeats in one of different texts of an id goes at that place from all of them.
    An empty table gives an empty result; other columns are ignored.
    """
    spans = repeated_spans(docs, id_col, text_col, length, gram, hot, chunk, buckets)
    listed = spans.groupBy(F.col("id").alias("i")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    listed = listed.select("i", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = own.join(listed, F.col("id") == F.col("i"), "left").select("id", "text", "starts", "stops")
    out = joined.mapInArrow(_cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
