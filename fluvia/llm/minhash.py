"""Near duplicates on word shingles: banded MinHash, odd sketches, confirmation on full sets, components.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a MinHash sample of
   bands x rows values, one hash a band, and the sample folded into a parity bitmap (odd sketch).
2. Texts of equal sets form a class; one row of a class stands for it from here on.
3. Classes that share a band are candidates. The exclusive-or population count of two odd sketches
   estimates how many samples differ; pairs that are far below the threshold are discarded there.
   The limit lies SIGMAS deviations beyond the mean of a pair at the threshold.
4. What is left is confirmed on full sets. A class is first confirmed against the likeliest of its
   bands' least members, so a group of n copies costs n confirmations.
5. Bands whose members then still lie in several components are open. Their members get an odd
   sketch of the whole set as well: equal shingles cancel in the exclusive or, so its population count
   never exceeds the number of shingles in which two texts differ, and a pair whose count is beyond
   what the threshold allows is ruled out for certain. Pairs of different components that this leaves
   are confirmed: first against each band's hub, the member that shares most bands (an unedited text
   among its edited copies), then all. No link between components is skipped.
6. Links go to distributed connected components.

With 40 bands of 4 rows, a pair at similarity 0.75 shares no band with probability 3e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .storage import among, dropped, joined_to_groups, written
from .textkit import LOWER, SPACE, U64, mix, pieces, stream, tidy

BANDS, ROWS, WORDS, SIMILARITY = 40, 4, 5, 0.75
SKETCH_LONGS = 8
#: 64-bit words of a whole set's odd sketch, for members of open bands.
SET_LONGS = 32
SIGMAS = 5.5
#: Shingles that are permuted at once, so that the block stays in cache.
BLOCK = 256


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; A-Z lower-cased, words split at white space."""
    weights = stream(11, words) | U64(1)
    for texts in pieces(column, LOWER):
        starts, ends, doc = texts.words(~SPACE)
        hashes = texts.hashes(starts, ends)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        if len(hashes) >= words:
            n = len(hashes) - words + 1
            rolled = np.zeros(n, U64)
            for k in range(words):
                rolled += hashes[k : k + n] * weights[k]
            rolled = mix(rolled)
        for i in range(len(texts)):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                own = np.zeros(1, U64)
                for k in range(b - a):
                    own += hashes[a + k : a + k + 1] * weights[k]
                yield mix(own + U64(b - a))
            else:
                yield np.zeros(0, U64)


def min_sample(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation h -> factor * h + shift modulo 2**32."""
    h = (hashes >> U64(32)).astype(np.uint32)[:, None]
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), BLOCK):
        np.minimum(out, (h[i : i + BLOCK] * factors + shifts).min(axis=0), out=out)
    return out


def odd_sketch(sample: np.ndarray, longs: int) -> np.ndarray:
    """Parity bitmap: every (permutation, value) flips one bit, so equal samples cancel in an exclusive or."""
    bit = mix(sample.astype(U64) | (np.arange(len(sample), dtype=U64) << U64(32))) % U64(64 * longs)
    parity = np.bincount(bit.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def expected_bits(similarity: float, samples: int, longs: int) -> float:
    """Expected population count of the exclusive or of two sketches."""
    m = 64 * longs
    return m / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / m))


def most_bits(similarity: float, samples: int, longs: int, sigmas: float = SIGMAS) -> int:
    """The count sigmas deviations beyond the mean of a pair at the similarity (of its samples and of the bits)."""
    m, differ = 64 * longs, samples * (1 - similarity)
    slope = 2 * math.exp(-4 * differ / m)
    of_samples = slope**2 * samples * similarity * (1 - similarity)
    of_bits = m / 4 * (1 - math.exp(-8 * differ / m))
    return math.ceil(expected_bits(similarity, samples, longs) + sigmas * math.sqrt(of_samples + of_bits))


def _signed(words: int, bands: int, rows: int, longs: int):
    samples = bands * rows
    factors = (stream(21, samples) >> U64(32)).astype(np.uint32) | np.uint32(1)
    shifts = (stream(22, samples) >> U64(32)).astype(np.uint32)
    fold = stream(23, rows) | U64(1)
    which = stream(24, bands)
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))]
        + [(f"s{k}", pa.int64()) for k in range(longs)]
    )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = len(batch)
            size = np.zeros(count, np.int64)
            marks = np.zeros((2, count), np.int64)
            bands_out = np.zeros((count, bands), np.int64)
            sketch = np.zeros((count, longs), np.int64)
            for i, own in enumerate(shingle_sets(batch.column(1), words)):
                size[i] = len(own)
                if len(own):
                    marks[0, i] = own.sum(dtype=U64).view(np.int64)
                    marks[1, i] = np.bitwise_xor.reduce(mix(own ^ U64(0x5851F42D4C957F2D))).view(np.int64)
                    sample = min_sample(own, factors, shifts)
                    folded = (sample.astype(U64).reshape(bands, rows) * fold).sum(axis=1, dtype=U64)
                    bands_out[i] = mix(folded + which).view(np.int64)
                    sketch[i] = odd_sketch(sample, longs)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (count + 1) * bands, bands, dtype=np.int32)), pa.array(bands_out.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(marks[0]), pa.array(marks[1]), lists]
                + [pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(longs)],
                schema=schema,
            )

    return tidy(signed)


def signatures(docs: DataFrame, words: int, bands: int, rows: int, longs: int) -> DataFrame:
    """id, n (set size), set_a and set_b (mark of the set), bands, s0.. (odd sketch) of (id, text) rows."""
    marks = ", ".join(f"s{k} long" for k in range(longs))
    return docs.mapInArrow(
        _signed(words, bands, rows, longs), f"id long, n long, set_a long, set_b long, bands array<long>, {marks}"
    )


def _apart(a: str, b: str, longs: int, kind: str = "s") -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{kind}{k}").bitwiseXOR(F.col(f"{b}.{kind}{k}"))) for k in range(longs)))


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.tobytes() for x in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.large_binary())], names=["id", "own"])

    return tidy(run)


def set_sketch(own: np.ndarray, longs: int) -> np.ndarray:
    """Odd sketch of a whole set of hashes."""
    parity = np.bincount((own % U64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def _set_sketches(words: int, longs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(batch), longs), np.int64)
            size = np.zeros(len(batch), np.int64)
            for i, own in enumerate(shingle_sets(batch.column(1), words)):
                size[i], rows[i] = len(own), set_sketch(own, longs)
            columns = [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *columns], names=["id", "n", *(f"f{k}" for k in range(longs))])

    return tidy(run)


def _confirmed(percent: int):
    """Keep pairs with 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(len(batch), bool)
            last: tuple = (None, None)
            for i in range(len(batch)):
                if last[0] != (key := batch.column("x")[i].as_py()):
                    last = (key, np.frombuffer(left[i].as_buffer(), U64))
                a, b = last[1], np.frombuffer(right[i].as_buffer(), U64)
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                    both = int((a[at] == b).sum())
                    keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("y")], names=["x", "y"]
            ).filter(pa.array(keep))

    return tidy(run)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of docs: its id, n_shingles, component_id (least id reachable) and kept.

    A text's set holds its distinct word shingles; a text of fewer words is one shingle, a null, empty
    or blank text has none and is linked with nothing. Rows that repeat an id and text get equal
    results; rows of one id with different texts are taken as linked. Null ids are reported with a
    null component, not kept. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    percent, longs = round(100 * similarity), SKETCH_LONGS
    samples = bands * rows
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(own, words, bands, rows, longs), "minhash-signed")
    sizes = signed.select("id", "n", "set_a", "set_b")
    count = signed.count()
    whole = signed.filter("n > 0 and id is not null")

    # Classes of equal sets: the least id stands for each.
    marked_as = {"set_a": "a", "set_b": "b", "n": "m"}
    classes = whole.groupBy(*[F.col(c).alias(d) for c, d in marked_as.items()]).agg(F.min("id").alias("rep"), F.count("*").alias("members"))
    classes = written(classes, "minhash-classes", rows=count)
    reps = written(
        joined_to_groups(whole, classes, marked_as, "members").filter(F.col("id") == F.col("rep"))
        .select("id", "n", "bands", *[f"s{k}" for k in range(longs)])
        .dropDuplicates(["id"]),
        "minhash-reps",
    )
    limit = most_bits(similarity, samples, longs)

    # Members of every band that at least two classes share, beside the band's least member.
    banded = reps.select(F.col("id"), F.explode("bands").alias("band"))
    shared = banded.groupBy(F.col("band").alias("b")).agg(F.min("id").alias("least"), F.count("*").alias("members")).filter("members > 1")
    shared = written(shared, "minhash-shared", rows=bands * count)
    members = written(joined_to_groups(banded, shared, {"band": "b"}, "members").select("band", "id", "least"), "minhash-bands", rows=bands * count)
    marks = reps.select("id", "n", *[f"s{k}" for k in range(longs)])

    def estimated(pairs: DataFrame) -> DataFrame:
        """(x, y) pairs that sizes and sketches leave possible, with the bits in which sketches differ."""
        x, y = marks.alias("p"), marks.alias("q")
        near = (
            pairs.join(x, F.col("x") == F.col("p.id")).join(y, F.col("y") == F.col("q.id"))
            .withColumn("bits", _apart("p", "q", longs))
            .filter((F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * percent) & (F.col("bits") <= limit))
        )
        return near.select("x", "y", "bits")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Links among (x, y) pairs, by the full sets of the texts."""
        pairs = written(pairs.select("x", "y"), "minhash-pairs", rows=bands * count)
        texts = among(own, pairs.select(F.col("x").alias("w")).union(pairs.select("y")).distinct())
        sets = written(texts.mapInArrow(_sets(words), "id long, own binary").dropDuplicates(["id"]), "minhash-sets")
        both = (
            pairs.join(sets.select(F.col("id").alias("yi"), F.col("own").alias("right")), F.col("y") == F.col("yi"))
            .join(sets.select(F.col("id").alias("xi"), F.col("own").alias("left")), F.col("x") == F.col("xi"))
            .select("x", "y", "left", "right")
        )
        out = written(both.mapInArrow(_confirmed(percent), "x long, y long"), name)
        dropped(pairs, sets)
        return out

    def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of which the sides lie in different components."""
        p, q = roots.select(F.col("vertex").alias("xv"), F.col("root").alias("xr")), roots.select(F.col("vertex").alias("yv"), F.col("root").alias("yr"))
        return (
            pairs.join(p, F.col("x") == F.col("xv"), "left").join(q, F.col("y") == F.col("yv"), "left")
            .filter(F.coalesce("xr", "x") != F.coalesce("yr", "y")).drop("xv", "xr", "yv", "yr")
        )

    def rooted_members(members: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of the bands that touch several components, with their roots."""
        placed = members.join(roots, F.col("id") == F.col("vertex"), "left").select(*members.columns, F.coalesce("root", "id").alias("root"))
        bands = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
        mixed = bands.filter("lo < hi").select(F.col("band").alias("b"))
        return placed.join(mixed, F.col("band") == F.col("b"), "left_semi")

    def possible(p: str, q: str) -> Column:
        """Whether two whole sets' sketches leave a link possible: differing shingles are at most (1-s)/(1+s) of both sizes."""
        return _apart(p, q, SET_LONGS, "f") * (100 + percent) <= (F.col(f"{p}.n") + F.col(f"{q}.n")) * (100 - percent)

    # Each class against the likeliest of its bands' least members.
    stars = written(estimated(members.filter("id > least").select(F.col("least").alias("x"), F.col("id").alias("y")).distinct()), "minhash-stars", rows=bands * count)
    best = stars.groupBy("y").agg(F.min_by("x", F.struct("bits", "x")).alias("x")).select("x", "y")
    links = confirmed(best, "minhash-links")
    roots = connected_components(links, "x", "y")

    # Members of open bands: how many members their bands have in all, and their whole sets' sketches.
    open_ = written(rooted_members(members.select("band", "id"), roots), "minhash-open", rows=bands * count)
    crowd = open_.groupBy(F.col("band").alias("b")).agg(F.count("*").alias("c"))
    weights = open_.join(crowd, F.col("band") == F.col("b")).groupBy("id").agg(F.sum("c").alias("weight"))
    weights = written(weights, "minhash-weights", rows=count)
    fields = ", ".join(f"f{k} long" for k in range(SET_LONGS))
    texts = among(own, weights.select("id")).dropDuplicates(["id"])
    sketches = texts.mapInArrow(_set_sketches(words, SET_LONGS), f"id long, n long, {fields}")
    marked = written(sketches.join(weights.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i"), "minhash-marked")
    placed = written(open_.select("band", "id").join(marked.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i"), "minhash-placed")

    def hubs(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("band").alias("b")).agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))

    # Each member of an open band against its hub.
    to_hub = rooted_members(placed, roots)
    to_hub = to_hub.join(hubs(to_hub), F.col("band") == F.col("b")).filter("id <> hub").select(F.col("hub").alias("x"), F.col("id").alias("y")).distinct()
    to_hub = rooted(to_hub, roots).join(marked.alias("p"), F.col("x") == F.col("p.id")).join(marked.alias("q"), F.col("y") == F.col("q.id"))
    links = links.union(confirmed(to_hub.filter(possible("p", "q")).select("x", "y"), "minhash-links"))
    roots = connected_components(links, "x", "y")

    # Every pair that is left: one side lies outside the component of its band's hub.
    still = written(rooted_members(placed, roots), "minhash-open", rows=bands * count)
    hub_roots = still.join(hubs(still), (F.col("band") == F.col("b")) & (F.col("id") == F.col("hub"))).select(F.col("band").alias("hb"), F.col("root").alias("hub_root"))
    outside = still.join(hub_roots, F.col("band") == F.col("hb")).filter("root != hub_root").alias("p")
    pairs = (
        outside.join(still.alias("q"), (F.col("p.band") == F.col("q.band")) & (F.col("p.root") != F.col("q.root")) & possible("p", "q"))
        .select(F.least("p.id", "q.id").alias("x"), F.greatest("p.id", "q.id").alias("y"))
        .distinct()
    )
    links = links.union(confirmed(pairs, "minhash-links"))
    roots = connected_components(links, "x", "y")

    # Back to every row: its class, the class's component, and the least id of all of them.
    named = classes.join(roots, F.col("rep") == F.col("vertex"), "left").select("a", "b", "m", "members", F.coalesce("root", "rep").alias("component"))
    own = sizes.filter("n > 0 and id is not null")
    out = joined_to_groups(own, written(named, "minhash-named", rows=count), marked_as, "members").select("id", "n", "component")
    out = out.union(sizes.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    component = F.col("component")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
