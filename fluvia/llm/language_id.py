"""Language identification by prediction by partial matching (PPM).

For every language a byte context tree of variable order gives the probability of each byte after
each context; a context that hasn't seen the byte escapes to the next shorter one (method C: with
`total` symbols seen, `distinct` different ones, an escape has distinct / (total + distinct)), below
order 0 all bytes are equally likely. Statistics are frozen after learning, so the code length of a
byte depends on the language and its longest context alone, and the trees of all languages become
one table of code lengths. A text's language is that with the shortest code.

The trees are learned from a bounded sample of labelled rows (MAX_ROWS of each language); whole
texts are then scored by one pass without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, Texts, give_back_memory, pieces, tidy

ORDER = 3
MAX_ROWS = 1500
#: Contexts of full order seen fewer times than this, in all languages together, stay out of the trees (1: none does).
LEAST_SEEN = 1
#: Contexts whose code lengths are worked out at once.
ROWS = 4096
#: Bytes of the table of code lengths, which every task gets.
MODEL_BYTES = 256 << 20
SEED = 29
UNKNOWN = "und"


def _alphabet(samples: list[Texts]) -> np.ndarray:
    """Symbols of bytes: 0 for what no sample has (and before a text's start), else 1, 2, ..."""
    seen = np.zeros(256, bool)
    for texts in samples:
        seen[texts.data] = True
    table = np.zeros(256, np.int32)
    table[seen] = np.arange(1, seen.sum() + 1)
    return table


def contexts(texts: Texts, symbol: np.ndarray, size: int) -> np.ndarray:
    """The ORDER symbols before each byte in one number, the nearest lowest; 0 stands before a text's start."""
    n = len(symbol)
    starts = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    out = np.zeros(n, np.int32)
    for back in range(1, ORDER + 1):
        part = np.zeros(n, np.int32)
        part[back:] = symbol[:-back]
        for k in range(back):
            at = starts + k
            part[at[at < n]] = 0
        out += part * np.int32(size ** (back - 1))
    return out


@dataclass
class Model:
    """langs; symbol of each byte; state of each last three symbols; nats of (state, symbol) by language."""

    langs: list[str]
    symbols: np.ndarray
    size: int
    states: np.ndarray
    nats: np.ndarray

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Nats of each text under each language, lower-cased as in learning."""
        out = np.zeros((len(column), len(self.langs)))
        a = self.size
        for texts in pieces(column, LOWER):
            n = len(texts.data)
            if not n:
                continue
            symbol = self.symbols[texts.data]
            cell = self.states[contexts(texts, symbol, a)] * np.int32(a) + symbol
            real = np.flatnonzero(np.diff(texts.offsets) > 0)
            for k in range(len(self.langs)):
                out[texts.first + real, k] = np.add.reduceat(self.nats[k][cell], texts.offsets[real], dtype=np.float64)
        return out


def fit_model(texts: dict[str, list[str | None] | pa.Array], least_seen: int = LEAST_SEEN, model_bytes: int = MODEL_BYTES) -> Model:
    """The context trees of each language's texts (whole texts, nothing cut, no context over two texts).

    least_seen is doubled until the table of code lengths, which grows with languages and contexts, has at most
    model_bytes; contexts that are left out share the state of their longest shorter one.
    """
    langs = sorted(texts)
    columns = [t if isinstance(t := texts[lang], pa.Array) else pa.array(t, pa.large_string()) for lang in langs]
    samples = [[p for p in pieces(column, LOWER) if len(p.data)] for column in columns]
    symbols = _alphabet([p for own in samples for p in own])
    a = int(symbols.max()) + 1
    # Contexts of full order that are seen often enough make states of their own; others share
    # the state of their longest shorter context, which is the remainder of their number.
    grams = np.zeros(a**3, np.int64)
    for own in samples:
        for p in own:
            grams += np.bincount(contexts(p, symbols[p.data], a), minlength=a**3)
    full = np.flatnonzero(grams >= least_seen)
    while len(full) and (a * a + len(full)) * a * 4 * len(langs) > model_bytes:
        least_seen *= 2
        full = np.flatnonzero(grams >= least_seen)
    del grams
    states = (np.arange(a**3, dtype=np.int64) % (a * a)).astype(np.int32)
    states[full] = a * a + np.arange(len(full), dtype=np.int32)
    nats = np.empty((len(langs), (a * a + len(full)) * a), np.float32)
    for k, own in enumerate(samples):
        none, one, two, three = (np.zeros(n, np.int32) for n in (a, a * a, a**3, len(full) * a))
        for p in own:
            s = symbols[p.data].astype(np.int64)
            c = contexts(p, symbols[p.data], a).astype(np.int64)
            np.add.at(none, s, 1)
            one += np.bincount(c % a * a + s, minlength=len(one)).astype(np.int32)
            two += np.bincount(c % (a * a) * a + s, minlength=len(two)).astype(np.int32)
            state = states[c].astype(np.int64) - a * a
            cell, times = np.unique((state * a + s)[state >= 0], return_counts=True)
            three[cell] += times.astype(np.int32)
        level = _escaped(none[None, :], np.full((1, a), 1.0 / a), np.zeros(1, np.int64))
        level = _escaped(one.reshape(a, a), level, np.zeros(a, np.int64))
        level = _escaped(two.reshape(a * a, a), level, np.arange(a * a) % a)
        nats[k, : a**3] = -np.log(level).astype(np.float32).ravel()
        three = three.reshape(len(full), a)
        for at in range(0, len(full), ROWS):
            part = _escaped(three[at : at + ROWS], level, full[at : at + ROWS] % (a * a))
            nats[k, a**3 + at * a : a**3 + at * a + part.size] = -np.log(part).astype(np.float32).ravel()
    return Model(langs, symbols, a, states, nats)


def _escaped(counts: np.ndarray, shorter: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probabilities of each row's symbols; unseen ones share the escape as the shorter context has them."""
    total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    base = shorter[parent]
    unseen = np.where(counts > 0, 0.0, base)
    left = unseen.sum(axis=1, keepdims=True)  # exclusion: what is seen here can't follow an escape
    escape = np.where(left > 0, distinct / np.maximum(total + distinct, 1), 0.0)
    seen = counts / np.maximum(total, 1) * (1 - escape)
    mixed = seen + escape * unseen / np.maximum(left, 1e-300)
    return np.where(total > 0, mixed, base)


def fit(docs: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from rows with id, text and language; of each language about max_rows rows, by a hash of the id."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter("id is not null and text is not null and lang is not null")
    if learn is not None:
        known = known.filter(learn)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part, chosen = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)), F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (part <= int(min(1.0, max_rows / n) * (1 << 30))))
    if not counts:
        return None
    rows = known.filter(chosen).select("lang", "text").toArrow()
    texts = {}
    for lang in counts:  # counts of bytes after bytes don't depend on the order of rows
        own = rows.filter(pc.equal(rows["lang"], lang))["text"]
        if own.num_chunks and len(own):
            texts[lang] = pa.concat_arrays(own.chunks)
    del rows
    model = fit_model(texts) if texts else None
    del texts
    give_back_memory()
    return model


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model is not None and n:
                nats = model.code_lengths(batch.column(1))
                best = nats.argmin(axis=1)
                share = 1 / np.exp(np.clip(nats.min(axis=1, keepdims=True) - nats, -700, 0)).sum(axis=1)
                told = np.asarray(batch.column(2))
                lang[told] = np.array(model.langs, object)[best[told]]
                score[told] = share[told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return tidy(run)


def predicted(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred and score (the language's share, 0 to 1, at equal priors).

    Texts that are null or have no letter get `und` and 0, and so does everything if no model could
    be learned. Ties go to the language first in order. Equal texts get equal results, an empty
    table gives an empty result, other columns are ignored.
    """
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), letter.alias("letter"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_predicted(model), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
