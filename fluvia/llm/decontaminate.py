"""Benchmark decontamination by FM-indexes over the training text.

Training texts are cut into shards, and each shard gets an FM-index over all its words: the suffix
order of its word sequence, the Burrows-Wheeler transform as a wavelet matrix with rank counts, and
samples of suffix positions. The indexes depend on the training text alone; they are written to the
shared folder and searched by every block of the benchmark (`built` gives them for later searches).

A block (at most BLOCK_BYTES of item text) travels to the executors. A shard maps the block's words to
its own symbols, searches all windows of known words backward at once, locates their occurrences by
walking to the next sample, and passes on the merged spans of each text. The spans of all blocks are
then merged once more. Training text is never shuffled, only the rows that were hit are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .textkit import ALNUM, LOWER, U64, pieces, tidy

WINDOW = 10
#: Item text that one pass over the indexes may carry to the executors.
BLOCK_BYTES = 32 << 20
#: Training text that one FM-index covers; a longer text has an index of its own.
SHARD_BYTES = 1 << 20
SAMPLE_STEP = 16
#: Rows of hits that may be broadcast to the list of rows, and their bytes, after summing them.
BROADCAST_BYTES = 32 << 20
SPANS = "spans array<struct<start:long,end:long>>"


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit vector a level, in words of 64 bits with counts before each."""

    def __init__(self, words: np.ndarray, zeros: np.ndarray):
        """words: a row of packed bits a level, most significant bit of the symbols first; zeros: how many a level has."""
        self.words, self.zeros, self.levels = words, zeros, len(zeros)
        self.counts = np.zeros((words.shape[0], words.shape[1] + 1), np.int64)
        np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64, out=self.counts[:, 1:])

    @classmethod
    def of(cls, sequence: np.ndarray, symbols: int) -> WaveletMatrix:
        n, levels = len(sequence), max(1, int(symbols - 1).bit_length())
        words, zeros = np.zeros((levels, n // 64 + 1), U64), np.zeros(levels, np.int64)
        now = sequence
        for k in range(levels):
            bit = ((now >> (levels - 1 - k)) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words[k] = np.packbits(padded, bitorder="little").view(U64)
            ones = now[bit]
            zeros[k] = n - len(ones)
            now = np.concatenate([now[~bit], ones])
        return cls(words, zeros)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position of the level."""
        word, rest = at >> 6, (at & 63).astype(U64)
        part = self.words[level][word] & ((U64(1) << rest) - U64(1))
        return self.counts[level][word] + np.bitwise_count(part)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            one_low, one_at = self._ones(k, low), self._ones(k, at)
            low = np.where(bit, self.zeros[k] + one_low, low - one_low)
            at = np.where(bit, self.zeros[k] + one_at, at - one_at)
        return at - low

    def symbols_at(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            bit = (self.words[k][at >> 6] >> (at & 63).astype(U64)) & U64(1)
            ones = self._ones(k, at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            out = (out << 1) | bit.astype(np.int64)
        return out


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling of those that are not told apart yet.

    The greatest depth is that of the longest repeat. The last symbol must be unique.
    """
    n, bits = len(sequence), max(1, int(sequence.max(initial=0) + 1).bit_length())
    width = max(1, 63 // bits)
    key = np.zeros(n + width, np.int64)
    key[:n] = sequence + 1  # 0 is beyond the end
    packed = np.zeros(n, np.int64)
    for k in range(width):
        packed = (packed << bits) | key[k : k + n]
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    new = np.concatenate([[True], packed[1:] != packed[:-1]])
    rank = np.empty(n, np.int64)
    heads = np.flatnonzero(new)
    rank[order] = heads[np.cumsum(new) - 1]
    open_ = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    while len(open_):
        rows = order[open_]
        own, after = rank[rows], np.minimum(rows + width, n - 1)
        key = own * (n + 1) + rank[after]
        by = np.argsort(key, kind="stable")
        order[open_], key = rows[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[open_]] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        width *= 2
    return order


class FMIndex:
    """Backward search and location over texts of symbols 1.., each of which ends with a 0 of its own."""

    def __init__(self, tree: WaveletMatrix, before: np.ndarray, marks: np.ndarray, samples: np.ndarray, n: int):
        self.tree, self.before, self.samples, self.n, self.marks = tree, before, samples, n, marks
        self.mark_counts = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), dtype=np.int64, out=self.mark_counts[1:])

    @classmethod
    def of(cls, sequence: np.ndarray, symbols: int, step: int = SAMPLE_STEP) -> FMIndex:
        """sequence: symbols 1 to symbols - 1, and a 0 at the end of each text."""
        n = len(sequence)
        ends = sequence == 0
        texts = int(ends.sum())
        # Ends of texts differ, in order of the texts, so no comparison goes beyond a text.
        told = np.where(ends, np.cumsum(ends) - 1, sequence + texts)
        order = suffix_order(told)
        before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])
        # Starts of texts are samples, so no walk back leaves its text.
        sampled = np.arange(n) % step == 0
        sampled[0] = True
        sampled[1:] |= ends[:-1]
        chosen = sampled[order]
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = chosen
        marks = np.packbits(padded, bitorder="little").view(U64)
        return cls(WaveletMatrix.of(sequence[order - 1], symbols), before, marks, order[chosen], n)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each row of patterns; all rows have one length."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k].astype(np.int64)
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.before[symbol] + both[: len(live)], self.before[symbol] + both[len(live) :]
            live = live[low[live] < high[live]]
            if not len(live):
                break
        found = np.zeros(len(patterns), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their place in the order."""
        out = np.empty(len(rows), np.int64)
        at, steps, open_ = rows.astype(np.int64), 0, np.arange(len(rows))
        while len(open_):
            word, rest = at >> 6, (at & 63).astype(U64)
            done = ((self.marks[word] >> rest) & U64(1)).astype(bool)
            rank = self.mark_counts[word] + np.bitwise_count(self.marks[word] & ((U64(1) << rest) - U64(1)))
            out[open_[done]] = self.samples[rank[done]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.tree.symbols_at(at)
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


def _built(with_spans: bool, shard_bytes: int):
    """(id, text) rows to shards: the rows' ids and numbers of words, and the index over their words."""

    def shard(number: int, ids: pa.Array, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        count = np.bincount(doc, minlength=len(ids)).astype(np.int64)
        vocabulary, coded = np.unique(hashes, return_inverse=True)
        sequence = np.zeros(len(hashes) + len(ids), np.int64)
        sequence[np.arange(len(hashes)) + doc] = coded.ravel() + 1
        index = FMIndex.of(sequence, len(vocabulary) + 1)
        blobs = {
            "counts": count.astype("<i4"), "vocabulary": vocabulary, "bits": index.tree.words, "zeros": index.tree.zeros,
            "before": index.before.astype("<i4"), "marks": index.marks, "samples": index.samples.astype("<i4"),
        } | ({"starts": starts.astype("<i4"), "ends": ends.astype("<i4")} if with_spans else {})
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in blobs.values())],
            names=["shard", "ids", *blobs],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        for batch in batches:
            first, size, parts = 0, 0, []
            for texts in pieces(batch.column(1), LOWER):
                starts, ends, doc = texts.words(ALNUM)
                base = texts.offsets[doc]
                parts.append((texts.hashes(starts, ends), starts - base, ends - base, doc + texts.first - first))
                size += len(texts.data)
                after = texts.first + len(texts)
                if size >= shard_bytes or after == len(batch):
                    yield shard(number, batch.column(0).slice(first, after - first), *(np.concatenate(x) for x in zip(*parts, strict=True)))
                    number, first, size, parts = number + 1, after, 0, []

    return tidy(run)


#: Bytes of indexes in a batch between Spark and a worker.
INDEX_BATCH = 8 << 20


def built(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards' indexes, written in the shared folder; any number of benchmarks can be searched in them.

    With spans, places of words in the texts are kept as well.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    blobs = ["counts", "vocabulary", "bits", "zeros", "before", "marks", "samples", *(["starts", "ends"] if spans else [])]
    schema = f"shard long, ids array<{kind}>, " + ", ".join(f"{b} binary" for b in blobs)
    return written(own.mapInArrow(_built(spans, shard_bytes), schema), "fm-index")


class Block:
    """Items' words as codes of a vocabulary, the distinct windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.names = [str(i) for i, _ in items]
        column = pa.array([t or "" for _, t in items], pa.large_string())
        hashes, counts = [np.zeros(0, U64)], []
        for texts in pieces(column, LOWER):
            starts, ends, doc = texts.words(ALNUM)
            hashes.append(texts.hashes(starts, ends))
            counts.append(np.bincount(doc, minlength=len(texts)))
        count = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        first = np.cumsum(count) - count
        self.vocabulary, coded = np.unique(np.concatenate(hashes), return_inverse=True)
        self.coded = coded.ravel().astype(np.int32)
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(np.minimum(count, window)).tolist():
            if not size:
                continue
            own = np.flatnonzero(count >= window if size == window else count == size)
            times = count[own] - size + 1
            item = np.repeat(own, times)
            at = np.repeat(first[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            # Equal windows are one: they get a number, a symbol at a time.
            number = np.zeros(len(at), np.int64)
            for k in range(size):
                number = np.unique(number * (len(self.vocabulary) + 1) + self.coded[at + k], return_inverse=True)[1].ravel()
            by = np.lexsort((item, number))
            number, item, at = number[by], item[by], at[by]
            fresh = np.concatenate([[True], (number[1:] != number[:-1]) | (item[1:] != item[:-1])])
            number, item, at = number[fresh], item[fresh], at[fresh]
            heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
            self.groups.append((size, at[heads], np.concatenate([heads, [len(number)]]), item))


def _merged(at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as disjoint ones that don't touch, in order."""
    by = np.argsort(at, kind="stable")
    at, reach = at[by], np.maximum.accumulate(until[by])
    new = np.concatenate([[True], at[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return at[new], reach[last]


HITS = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("from", pa.list_(pa.int32())), ("to", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _searched(block: Block):
    """Shards to their rows with occurrences of the block's windows: merged ranges of words, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                blob = {name: np.frombuffer(batch.column(name)[k].as_buffer(), kind) for name, kind in (("counts", "<i4"), ("vocabulary", U64), ("bits", U64), ("zeros", np.int64), ("before", "<i4"), ("marks", U64), ("samples", "<i4"))}
                vocabulary, count = blob["vocabulary"], blob["counts"].astype(np.int64)
                if not len(vocabulary) or not len(block.vocabulary):
                    continue
                place = np.minimum(np.searchsorted(vocabulary, block.vocabulary), len(vocabulary) - 1)
                symbol = np.where(vocabulary[place] == block.vocabulary, place + 1, 0).astype(np.int32)
                coded = symbol[block.coded]
                unknown = np.concatenate([[0], np.cumsum(coded == 0)])
                levels = len(blob["zeros"])
                tree = index = None
                ends = np.cumsum(count + 1)  # in the sequence, behind each row's end mark
                at_all, until_all, row_all, pairs = [], [], [], []
                for size, starts, owned, owners in block.groups:
                    live = np.flatnonzero(unknown[starts + size] == unknown[starts])
                    if not len(live):
                        continue
                    if index is None:
                        tree = WaveletMatrix(blob["bits"].reshape(levels, -1), blob["zeros"])
                        index = FMIndex(tree, blob["before"].astype(np.int64), blob["marks"], blob["samples"], int(ends[-1]))
                    low, high = index.search(np.lib.stride_tricks.sliding_window_view(coded, size)[starts[live]])
                    found = np.flatnonzero(low < high)
                    if not len(found):
                        continue
                    times = high[found] - low[found]
                    which = np.repeat(live[found], times)
                    rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
                    at = index.locate(rows)
                    row = np.searchsorted(ends, at, "right")
                    at_all.append(at)
                    until_all.append(at + size)
                    row_all.append(row)
                    # Each row's windows once, then their items.
                    window, row = np.divmod(np.unique(which * len(count) + row), len(count))
                    each = owned[window + 1] - owned[window]
                    item = owners[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(owned[window], each)]
                    pairs.append(np.unique(np.repeat(row, each) * len(block.names) + item))
                if not at_all:
                    continue
                # Ranges of different rows never touch, as an end mark lies between them.
                at, until = _merged(np.concatenate(at_all), np.concatenate(until_all))
                row = np.searchsorted(ends, at, "right")
                base = np.concatenate([[0], ends])[row]
                hit, first = np.unique(row, return_index=True)
                bounds = pa.array(np.append(first, len(row)).astype(np.int32))
                own, item = np.divmod(np.unique(np.concatenate(pairs)), len(block.names))
                names = pa.array(block.names, pa.string()).take(pa.array(item))
                lists = pa.array(np.searchsorted(own, np.append(hit, len(count))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(hit), batch.column("shard")[k].as_py(), np.int64)), pa.array(hit.astype(np.int32)),
                        pa.ListArray.from_arrays(bounds, pa.array((at - base).astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array((until - base).astype(np.int32))),
                        pa.ListArray.from_arrays(lists, names),
                    ],
                    schema=HITS,
                )

    return tidy(run)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the ranges of all blocks to merged ranges, and how many words these cover."""
    for batch in batches:
        hit, froms, tos = [], [], []
        for a, b in zip(batch.column("from"), batch.column("to"), strict=True):
            at, until = _merged(np.asarray(a.values), np.asarray(b.values))
            hit.append(int((until - at).sum()))
            froms.append(at)
            tos.append(until)
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (froms, tos)]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("row"), pa.array(hit, pa.int64()), *lists, batch.column("items")], names=["shard", "row", "n_hit", "from", "to", "items"])


def _rows(kind: pa.DataType | None, with_spans: bool):
    """Shards to their rows: id and number of words, and with spans the places of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                count = np.frombuffer(batch.column("counts")[k].as_buffer(), "<i4")
                n = len(count)
                columns = {
                    "shard": pa.array(np.full(n, batch.column("shard")[k].as_py(), np.int64)), "row": pa.array(np.arange(n, dtype=np.int32)),
                    "id": batch.column("ids")[k].values, "n_words": pa.array(count.astype(np.int64)),
                }
                if with_spans:
                    bounds = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                    for name in ("starts", "ends"):
                        columns[name] = pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(batch.column(name)[k].as_buffer(), "<i4")))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return tidy(run)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, one block on the driver at a time; one empty block for no items."""
    rows = benchmark.select(F.col(item_col), F.col(text_col)).toLocalIterator()
    block, size, some = [], 0, False
    for item, text in rows:
        if item is None or not text:
            continue
        block.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def searched(shards: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, row, n_hit, from, to, items) of the rows of `built` shards in which windows of items occur.

    from and to are disjoint ranges of words. Each block of the benchmark is one pass over the indexes.
    """
    schema = "shard long, row int, `from` array<int>, `to` array<int>, items array<string>"
    index = shards.select("shard", "counts", "vocabulary", "bits", "zeros", "before", "marks", "samples")
    found = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        part = written(index.mapInArrow(_searched(Block(block, window)), schema), "fm-hits", INDEX_BATCH)
        found = part if found is None else found.unionByName(part)
    united = found.groupBy("shard", "row").agg(
        F.flatten(F.collect_list("from")).alias("from"), F.flatten(F.collect_list("to")).alias("to"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return written(united.mapInArrow(tidy(_united), "shard long, row int, n_hit long, `from` array<int>, `to` array<int>, items array<string>"), "fm-found")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    spans: bool = False,
    shard_bytes: int = SHARD_BYTES,
    shards: DataFrame | None = None,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (sorted names of items with occurring windows).

    A window is a run of `window` item words, or all words of a shorter item; a document word inside
    any occurrence is hit. With spans, also the merged byte ranges to remove from the UTF-8 text.
    shards may give the indexes that `built` made of docs before. Null and blank texts have no words, on
    either side; items without an id are left out; an item that repeats counts once; an empty
    benchmark hits nothing and an empty table gives an empty result. Ids may repeat or be null, as rows
    are told apart by shard and place. However many blocks the benchmark has, the rows and the
    spans are the same. Other columns are ignored.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    index = built(docs, id_col, text_col, spans, shard_bytes) if shards is None else shards
    found = searched(index, benchmark, item_col, item_text_col, window, block_bytes)
    wide = ", starts array<int>, ends array<int>" if spans else ""
    rows = index.select("shard", "ids", "counts", *(["starts", "ends"] if spans else [])).mapInArrow(_rows(None, spans), f"shard long, row int, id {kind}, n_words long{wide}")
    own = found.select(F.col("shard").alias("s"), F.col("row").alias("r"), "n_hit", "from", "to", "items")
    own = own if spans else own.drop("from", "to")
    size = own.agg(F.coalesce(F.sum(32 + F.lit(32) * F.size("items") + (F.lit(8) * F.size("from") if spans else F.lit(0))), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(own) if size <= BROADCAST_BYTES else own.hint("merge"), (F.col("shard") == F.col("s")) & (F.col("row") == F.col("r")), "left")
    columns = [F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    if spans:
        ranges = F.transform(
            F.arrays_zip("from", "to"),
            lambda x: F.struct(F.element_at("starts", x["from"] + 1).cast("long").alias("start"), F.element_at("ends", x["to"]).cast("long").alias("end")),
        )
        columns.append(F.coalesce(ranges, F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
    return joined.select(*columns)


def items_sha256(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
