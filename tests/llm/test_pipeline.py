"""The stages on the smallest tables, each against a plain version on what it was given."""

import hashlib

import brute
import numpy as np

import corpus_pipeline as p
from fluvia.llm import queries
from fluvia.llm.sentencepiece_bpe import encoder, unpacked
from fluvia.llm.storage import written


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "minhash", "decontaminate", "sentencepiece"]
    score = {r["doc_id"]: r["predicted"] for r in queries.op1_toxicity(spark, sf_dir).collect()}
    kept = {}
    for name, stage in p.STAGES[:-1]:
        before = rows_of(docs)
        docs = written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns
        after = {i for i, _ in rows_of(docs)}
        if name == "toxicity":
            want = {i for i, _ in before if not score[i]}
        elif name == "exact_dedup":
            want = {i for i, v in brute.exact_groups(before).items() if v[2]}
        elif name == "minhash":
            want = {i for i, v in brute.near_components(before).items() if v[1] == i}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            want = {i for i, v in brute.contamination(before, items).items() if not v[1]}
        assert after == want
        kept[name] = len(after)
    out = p.STAGES[-1][1](spark, docs, sf_dir).collect()
    library = encoder(queries.piece_model_path()).library
    texts = dict(rows_of(docs))
    assert len(out) == kept["decontaminate"]
    assert all(unpacked(bytes(r["ids"])) == library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True) for r in out)


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "Two  words"), (2, ""), (3, None), (4, "é\u2581 \U0001f600x")], "doc_id long, text string")
    out = p.tokens(spark, docs, "").collect()
    library = encoder(queries.piece_model_path()).library
    assert len(out) == 4
    assert all(r["decoded_sha256"] == hashlib.sha256(library.decode(unpacked(bytes(r["ids"]))).encode()).hexdigest() for r in out)


def test_held_out_accuracy(spark):
    """On rows whose labels were never learned from, at a size with enough of them."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["predicted"], labels[r["doc_id"]]) for r in queries.op1_toxicity(spark, sf).filter("held_out").collect() if r["doc_id"] in labels]
    got, want = np.array(rows).T
    assert (got == want).mean() > 0.97 and (got & want).sum() / got.sum() > 0.95


def test_null_columns(spark, sf_dir):
    """Stages stand nulls in every column and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", None, None, None), (900001, "", None, None, None)], docs.schema)
    for some in (odd, odd.filter("false")):
        n = some.count()
        for _, stage in p.STAGES:
            out = stage(spark, written(some, "test"), sf_dir)
            assert out.count() <= n
