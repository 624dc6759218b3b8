"""Toxicity: a linear classifier that is fitted with counterfactual regularisation.

Features are hashed words and hashed word beginnings, with logarithmic counts, each scaled by its
class ratio in the fitted rows (rare features are left out). Besides the logistic loss, the fit
swaps the identity terms of every labelled text that has any for other terms of their group, and
penalises the squared change of the score; so the label of the sentences in which a group happens
to be mentioned does not settle on the group's name.

The model is fitted on a bounded sample of labelled rows (MAX_ROWS of each class, weighted back to
the true rate); texts are scored by one pass over whole texts without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .textkit import ALNUM, LOWER, U64, give_back_memory, pieces, tidy

BITS = 18
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (5, 7)
#: Entries of sparse rows that are worked on at once.
ENTRIES = 1 << 19
#: Hashed features of all kinds.
SPACE = (1 + len(BEGINNINGS)) << BITS
#: Labelled rows of each class that the fit is made on, and their bytes of text (a bound on what the driver gets).
MAX_ROWS, MAX_BYTES = 4000, 64 << 20
LEAST_ROWS = 3
L2, PENALTY, STEPS, RATE = 1e-4, 1.0, 80, 0.1
SEED = 17
#: Groups of identity terms; the terms of a group take each other's place.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"), ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled"), ("elderly", "young"), ("poor", "rich"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


@dataclass
class Rows:
    """Sparse rows: row, feature and value of every entry."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    count: int

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for k in range(0, len(self.row), ENTRIES):
            yield self.row[k : k + ENTRIES], self.feature[k : k + ENTRIES], self.value[k : k + ENTRIES]

    def score(self, weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(self.count, float(bias))
        for row, feature, value in self._parts():
            out += np.bincount(row, value * weights[feature], self.count)
        return out

    def spread(self, slope: np.ndarray, n: int) -> np.ndarray:
        """For each of n features the sum over rows of its value times the row's slope."""
        out = np.zeros(n)
        for row, feature, value in self._parts():
            out += np.bincount(feature, value * slope[row], n)
        return out


def features(column: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, Rows]]:
    """For runs of texts, the first one's place and their features; with known, only features it marks."""
    for texts in pieces(column, LOWER):
        starts, ends, doc = texts.words(ALNUM)
        h = texts.prefix_hash()
        doc = doc.astype(U64) << U64(BITS + 2)
        keys = []
        for kind, length in enumerate((None, *BEGINNINGS)):
            until = ends if length is None else np.minimum(starts + length, ends)
            feature = (texts.hashes(starts, until, h) >> U64(64 - BITS)) | U64(kind << BITS)
            key = doc | feature
            keys.append(key if known is None else key[known[feature.astype(np.int64)]])
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        feature = (key & U64((1 << (BITS + 2)) - 1)).astype(np.int32)
        yield texts.first, Rows((key >> U64(BITS + 2)).astype(np.int32), feature, np.log1p(times).astype(np.float32), len(texts))


def _column(texts: list[str | None] | pa.Array) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())


def _all_rows(texts: list[str | None] | pa.Array, known: np.ndarray | None = None, size: int | None = None) -> Rows:
    """All texts' features as one; size, if it is known, is how many entries these are."""
    column = _column(texts)
    if size is None:
        size = sum(len(part.row) for _, part in features(column, known))
    out = Rows(np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.float32), len(texts))
    at = 0
    for first, part in features(column, known):
        end = at + len(part.row)
        out.row[at:end], out.feature[at:end], out.value[at:end] = part.row + np.int32(first), part.feature, part.value
        at = end
    return out


def _text(x: str | None | pa.Scalar) -> str | None:
    return x.as_py() if isinstance(x, pa.Scalar) else x


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, turn: int = 1) -> str:
    """The text with every identity term replaced by the term that stands turn places on in its group."""
    after = {term: group[(k + turn) % len(group)] for group in groups for k, term in enumerate(group)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, after), key=len, reverse=True)) + r")\b", re.IGNORECASE)
    return pattern.sub(lambda m: after[m[0].lower()], text)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array, known: np.ndarray) -> np.ndarray:
        z = np.full(len(column), self.bias)
        for first, rows in features(column, known):
            z[first : first + rows.count] = rows.score(self.weights, self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def scorer(self):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = self.weights != 0
            for batch in batches:
                score = pa.array(self.scores(batch.column(1), known))
                yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["id", "score"])

        return tidy(run)

    def sieve(self, text_at: int, limit: float):
        """Pass on the rows whose text scores below the limit, with all columns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = self.weights != 0
            for batch in batches:
                yield batch.filter(pa.array(self.scores(batch.column(text_at), known) < limit))

        return tidy(run)


class Fit:
    """Labelled texts as features, and the loss to be minimised over the weights of those that count.

    The loss is the weighted mean logistic loss, plus `penalty` times the weighted mean of the squared change of a score when a
    text's identity terms are swapped, plus l2 / 2 of the squared weights (before features are scaled).
    """

    def __init__(self, texts: list[str | None] | pa.Array, y: np.ndarray, weight: np.ndarray | None = None, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, penalty: float = PENALTY, least_rows: int = LEAST_ROWS, l2: float = L2):
        self.y, self.penalty, self.l2 = np.asarray(y, float), penalty, l2
        weight = np.ones(len(self.y)) if weight is None else np.asarray(weight, float)
        self.weight = weight / weight.sum()
        # Texts are read twice, so that only features that count are ever held.
        seen, pos, toxic = np.zeros(SPACE, np.int64), np.ones(SPACE), self.y.sum()
        for first, part in features(_column(texts)):
            seen += np.bincount(part.feature, minlength=SPACE)
            pos += np.bincount(part.feature[self.y[part.row + first] > 0], minlength=SPACE)
        neg = seen - pos + 2.0
        self.ratio = np.log(pos / (toxic + 2)) - np.log(neg / (len(self.y) - toxic + 2))
        self.ratio[seen < least_rows] = 0
        self.used = np.flatnonzero(self.ratio)
        self.place = np.full(SPACE, -1, np.int32)
        self.place[self.used] = np.arange(len(self.used))
        self.own = self.scaled(texts, int(seen[self.used].sum()))
        self.pairs: list[tuple[np.ndarray, Rows]] = []
        if penalty and groups:
            for turn in range(1, min(3, max(map(len, groups)))):
                other = [(k, s) for k, t in enumerate(map(_text, texts)) if t and (s := swapped(t, groups, turn)) != t]
                if other:
                    self.pairs.append((np.array([k for k, _ in other]), self.scaled([s for _, s in other])))

    def scaled(self, texts: list[str | None] | pa.Array, size: int | None = None) -> Rows:
        """Rows of the features that count, times their class ratios."""
        rows = _all_rows(texts, self.place >= 0, size)
        for _, feature, value in rows._parts():  # parts are views
            value *= self.ratio[feature].astype(np.float32)
            feature[:] = self.place[feature]
        return rows

    def loss(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """The loss and its gradient."""
        z = np.clip(self.own.score(w, bias), -500, 500)
        loss = float(self.weight @ (np.logaddexp(0, z) - self.y * z)) + self.l2 / 2 * float(w @ w)
        slope = self.weight * (1 / (1 + np.exp(-z)) - self.y)
        grad_b, grad = float(slope.sum()), self.l2 * w
        for at, other in self.pairs:
            change = z[at] - other.score(w, bias)
            loss += self.penalty * float(self.weight[at] @ change**2)
            change *= 2 * self.penalty * self.weight[at]  # the bias falls out of the difference
            slope[at] += change
            grad -= other.spread(change, len(w))
        return loss, grad + self.own.spread(slope, len(w)), grad_b

    def model(self, w: np.ndarray, bias: float) -> Model:
        weights = np.zeros(SPACE, np.float32)
        weights[self.used] = w * self.ratio[self.used]
        return Model(weights, float(bias))


def fit_model(texts: list[str | None] | pa.Array, toxic: np.ndarray, weight: np.ndarray | None = None, steps: int = STEPS, **options) -> Model:
    """Fit on (text, label) rows, by Adam; without rows of both classes the score is the share of the one there is."""
    y = np.asarray(toxic, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(SPACE, np.float32), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    fit = Fit(texts, y, weight, **options)
    share = float(fit.weight @ y)
    w, bias = np.zeros(len(fit.used)), float(np.log(share / (1 - share)))
    first, second, first_b, second_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        _, grad, grad_b = fit.loss(w, bias)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * grad_b, 0.99 * second_b + 0.01 * grad_b**2
        up, down = 1 - 0.9**step, 1 - 0.99**step
        w -= RATE * (first / up) / (np.sqrt(second / down) + 1e-9)
        bias -= RATE * (first_b / up) / (np.sqrt(second_b / down) + 1e-9)
    return fit.model(w, bias)


def remainder(id_: Column, parts: int) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, **options) -> Model:
    """A model from the labelled texts of docs (doc_id, text) and labels (doc_id, toxic).

    learn says of doc_id which rows may teach. Rows without id or label are left out; of repeated
    labels the higher counts. At most about max_rows rows of each class, and of these as many as
    have max_bytes of text together, are fetched in the order of a hash of the id.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    if learn is not None:
        known = known.filter(learn)
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = known.withColumn("part", F.pmod(F.xxhash64("label_id", F.lit(SEED)), F.lit(1 << 30)))
    chosen = F.lit(False)
    for label, n in counts.items():
        chosen = chosen | ((F.col("toxic") == label) & (F.col("part") <= int(min(1.0, max_rows / n) * (1 << 30))))
    # The sample is bounded by max_rows, and so is what is broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(known.filter(chosen)), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic", "part")
    sample = written(sample, "toxicity-sample")
    before = Window.partitionBy("toxic").orderBy("part", "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sample.withColumn("before", F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before), F.lit(0)))
    rows = sizes.filter(F.col("before") < max_bytes).select("doc_id", "text", "toxic").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.array(rows["toxic"].to_pylist(), float)
    got = {label: max(1, int((y == label).sum())) for label in counts}
    weight = np.array([counts[int(k)] / got[int(k)] for k in y])
    texts = pa.concat_arrays(rows["text"].chunks) if rows["text"].num_chunks else pa.array([], pa.string())
    del rows
    model = fit_model(texts, y, weight, **options)
    del texts
    give_back_memory()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and the score, 0 to 1.

    Null and empty texts get the score of a text without features; an empty table gives an empty
    result; equal texts get equal scores. Other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(model.scorer(), f"id {kind}, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the limit."""
    return docs.mapInArrow(model.sieve(docs.columns.index(text_col), limit), docs.schema)
