"""Exact and near duplicates, and repeated strings, against plain versions."""

import hashlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvia.llm import minhash, storage, suffix_dedup
from fluvia.llm.exact_dedup import DigestIndex, digests, exact_duplicates
from fluvia.llm.graph import connected_components
from fluvia.llm.textkit import SPACE, pieces


def test_exact(documents, corpus):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_duplicates(documents).collect()}
    assert got == brute.exact_groups(corpus)


def test_exact_over_batches(spark, documents, corpus):
    """What the index knows stays; only new digests are appended; its plan sorts and merges."""
    index = DigestIndex(spark, buckets=4)
    first = [(i, t) for i, t in corpus if i % 2]
    exact_duplicates(documents.filter("doc_id % 2 = 1"), index=index)
    known = {r["digest"]: r["keep_id"] for r in index.read().collect()}
    out = exact_duplicates(documents.filter("doc_id % 2 = 0"), index=index).collect()
    assert all(r["keep_id"] == known[r["text_sha256"]] and not r["kept"] for r in out if r["text_sha256"] in known)
    assert index.read().count() == index.read().select("digest").distinct().count() == len({d for *_, d in brute.exact_groups(corpus).values()})
    assert len(known) == len({d for *_, d in brute.exact_groups(first).values()})


def test_an_index_is_opened_again(spark, documents, corpus, tmp_path):
    """Files alone, under another name and without the number of buckets, as a new session finds them; queries leave no table behind."""
    path = f"file://{tmp_path}/index"
    index = DigestIndex(spark, path, buckets=3)
    exact_duplicates(documents.filter("doc_id % 2 = 1"), index=index)
    known = {r["digest"]: r["keep_id"] for r in index.read().collect()}
    index.close()
    tables = {t.name for t in spark.catalog.listTables()}
    again = DigestIndex(spark.newSession(), path, table="opened_again")
    assert again.buckets == 3 and {r["digest"]: r["keep_id"] for r in again.read().collect()} == known
    out = exact_duplicates(documents.filter("doc_id % 2 = 0"), index=again).collect()
    assert any(r["text_sha256"] in known for r in out) and all(r["keep_id"] == known[r["text_sha256"]] for r in out if r["text_sha256"] in known)
    again.destroy()
    assert not (tmp_path / "index").exists()
    exact_duplicates(documents).count()
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_exact_ties_nulls_and_repeats(spark):
    rows = [(2, "a b"), (1, "ab "), (3, "a  b"), (None, "ab"), (5, "ab"), (5, "ab"), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {r["keep_id"] for r in out if r["group_size"] == 6} == {3}
    assert [r["kept"] for r in out if r["doc_id"] is None] == [False, False]
    assert {r["keep_id"] for r in out if r["group_size"] == 2} == {7}


def test_empty_tables(nothing):
    assert exact_duplicates(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0
    assert suffix_dedup.without_repeats(nothing).count() == 0


def test_exact_uses_no_python(documents):
    plan = digests(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near(documents, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents).collect()}
    assert got == brute.near_components(corpus)


def test_near_nulls_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (4, text), (None, text), (9, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in out)[1:] == [(1, 1, True), (1, 1, True), (4, 1, False), (9, 9, True)]
    assert not next(r for r in out if r["doc_id"] is None)["kept"]


def test_near_in_one_crowd(spark):
    """Many edited copies of a text, among them pairs that are linked through the original only."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(80)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        words = list(base)
        for at in rng.integers(0, 80, rng.integers(1, 4)):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: c for i, (_, c) in brute.near_components(rows).items()}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_set_sketch_never_exceeds_the_difference(a, b):
    x, y = (minhash.set_sketch(np.array(sorted(s), np.uint64), 4) for s in (a, b | set(list(a)[::2])))
    assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a ^ (b | set(list(a)[::2])))


def test_sketch_limit_lets_similar_pairs_pass():
    rng = np.random.default_rng(1)
    samples = minhash.BANDS * minhash.ROWS
    limit = minhash.most_bits(0.75, samples, minhash.SKETCH_LONGS)
    over = 0
    for _ in range(300):
        a = rng.integers(0, 2**32, samples, dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random(samples) < 0.75, a, rng.integers(0, 2**32, samples, dtype=np.uint64).astype(np.uint32))
        bits = np.bitwise_count((minhash.odd_sketch(a, minhash.SKETCH_LONGS) ^ minhash.odd_sketch(b, minhash.SKETCH_LONGS)).view(np.uint64)).sum()
        over += bits > limit
    assert over == 0


@pytest.mark.parametrize("options", [{}, {"hot": 2, "chunk": 50}, {"buckets": 97}, {"buckets": 60, "hot": 1}])
def test_repeated_strings(documents, corpus, options):
    out = suffix_dedup.without_repeats(documents, **options).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == brute.without_repeats(corpus)


def test_repeats_without_ids(spark):
    text = "y" + "abcdefghij" * 30
    rows = [(None, text), (1, text), (1, text), (2, text)]
    out = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = sorted((r["doc_id"] or 0, r["n_removed"]) for r in out)
    assert by[0] == (0, 0) and by[1] == by[2] and by[3] == (2, len(text))


def test_a_crowded_anchor(spark):
    """A line in most texts, with different and with equal surroundings, over more buckets than texts; a very long text as well."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{rng.integers(500)}" for _ in range(n))
    line = "this one line stands in nearly all of the texts and is as long as a window, or somewhat longer than that is."
    rows = [(k, f"{words(20)} {line} {words(20)}") for k in range(60)] + [(100 + k, f"same before {line} same after {words(15)}") for k in range(40)]
    rows += [(200 + k, f"{line}{line}") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"buckets": 150}, {"buckets": 7, "hot": 10}, {}):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.without_repeats(df, **options).collect()}
        assert got == brute.without_repeats(rows)


def test_few_windows_of_different_extents_are_sorted(monkeypatch):
    """A passage between surroundings of its own in each text: its edges become equal extents before any window is sorted."""
    rng = np.random.default_rng(10)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    passage = letters(150)
    texts = [letters(80 + k) + passage + letters(120) for k in range(50)]
    flat = suffix_dedup.Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 0)
    e = suffix_dedup.extents(flat, 100, 32)
    at, ends = e["at"], e["at"] + e["windows"] + 99
    columns = [[flat.data[a:b].tobytes() for a, b in zip(e["anchor"], ends, strict=True)], [flat.data[a:b].tobytes() for a, b in zip(at, e["anchor"], strict=True)]]
    extents = pa.RecordBatch.from_arrays([*(pa.array(c, pa.binary()) for c in columns), pa.array(e["doc"]), pa.array((at - flat.offsets[e["doc"]]).astype(np.int32))], names=["after", "before", "id", "at"])
    sorted_, plain = [], suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda blob, starts, *rest: (sorted_.append(len(starts)), plain(blob, starts, *rest))[1])
    covered = {k: set() for k in range(50)}
    for batch in suffix_dedup._compared(100, 32, None, suffix_dedup.CHUNK)(iter([extents])):
        for row in batch.to_pylist():
            covered[row["id"]] |= set(range(row["start"], row["stop"]))
    assert {k: len(v) for k, v in covered.items()} == {k: n for k, (_, n, _, _) in brute.without_repeats([(k, t.decode()) for k, t in enumerate(texts)]).items()}
    assert covered[0] == set() and len(covered[49]) >= 150
    assert sum(sorted_) < 500


def test_suffixes_are_dealt_out_in_order():
    """By sampled splitters, rows that share all of their lead included; each suffix goes to one bucket."""
    rng = np.random.default_rng(11)
    keys = rng.integers(-2, 3, (3000, suffix_dedup.LEAD + 2))
    split = suffix_dedup.splitters(keys[rng.random(3000) < 0.1], 40)
    got = suffix_dedup.bucket_of(keys, split)
    assert split.shape == (39, suffix_dedup.LEAD + 2)
    assert got.tolist() == [sum(tuple(s) <= tuple(k) for s in split.tolist()) for k in keys.tolist()]
    assert np.bincount(got, minlength=40).max() < 300
    assert not suffix_dedup.bucket_of(keys, suffix_dedup.splitters(keys[:0], 40)).any()
    texts = pa.RecordBatch.from_arrays([pa.array([3, 4]), pa.array(["a" * 500, "".join(map(chr, rng.integers(97, 123, 5000)))])], names=["id", "text"])
    whole = [np.frombuffer(r["rows"], np.int64).reshape(-1, suffix_dedup.LEAD + 2) for b in suffix_dedup._sampled(100, 32, 1.0)(iter([texts])) for r in b.to_pylist()]
    split = suffix_dedup.splitters(np.concatenate(whole), 9)
    blobs = [(r["bucket"], np.frombuffer(r["rows"], np.int64).reshape(suffix_dedup.LEAD + 2, -1).T) for b in suffix_dedup._suffixes(100, 32, split)(iter([texts])) for r in b.to_pylist()]
    assert {b for b, _ in blobs} == set(range(9))
    assert all((suffix_dedup.bucket_of(rows, split) == b).all() for b, rows in blobs)


def test_long_texts_come_in_parts(spark):
    rng = np.random.default_rng(9)
    body = bytes(rng.integers(97, 123, 5 << 20, dtype=np.uint8)).decode()
    df = spark.createDataFrame([(1, body), (2, "short"), (3, "x" + body[(1 << 20) - 300 : (1 << 20) + 400] + "y" + body[-150:])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.without_repeats(df).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (850, 2)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=1, max_size=60))
def test_multikey_quicksort(rows):
    m = np.array(rows)
    order, shared = suffix_dedup.multikey_quicksort(m)
    want = sorted(range(len(rows)), key=lambda k: (rows[k], k))
    assert order.tolist() == want
    common = [next((d for d in range(3) if rows[a][d] != rows[b][d]), 3) for a, b in zip(want, want[1:], strict=False)]
    assert shared.tolist() == [0, *common]


@pytest.mark.parametrize("several", [1, 3, 50_000])
def test_large_groups_are_joined_like_others(spark, monkeypatch, several):
    """However many groups are broadcast, all rows of all groups come, each once."""
    monkeypatch.setattr(storage, "LARGE_GROUPS", several)
    keys = [0] * 40 + [1] * 9 + [2] * 8 + list(range(3, 30)) + [None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k long")
    groups = spark.createDataFrame([(k, keys.count(k), f"g{k}") for k in set(keys) - {None, 5}], "kk long, n long, name string")
    got = storage.joined_to_groups(rows, groups, {"k": "kk"}, "n").collect()
    assert sorted((r["id"], r["name"]) for r in got) == [(i, f"g{k}") for i, k in enumerate(keys) if k is not None and k != 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=12), max_size=8))
def test_words_stay_inside_texts(texts):
    import pyarrow as pa

    got = []
    for t in pieces(pa.array(texts, pa.string()), piece_bytes=7):
        starts, ends, doc = t.words(~SPACE)
        got += [(t.first + int(d), bytes(t.data[s:e]).decode()) for s, e, d in zip(starts, ends, doc, strict=True)]
    assert got == [(k, w) for k, text in enumerate(texts) for w in text.split()]


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(300, 340, (30, 2))] + [(5, 5), (None, 3), (8, None)]
    part = {x: x for p in pairs if None not in p for x in p}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            part[max(x, y)] = min(x, y)
    got = {r["vertex"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for x in part if root(x) != x}
