"""Toxicity, language, tokens and contamination."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvia.llm import decontaminate, language_id, toxicity
from fluvia.llm.queries import piece_model_path
from fluvia.llm.sentencepiece_bpe import encoded, encoder, unpacked


def sentences(rng, n, toxic_share=0.5):
    words = [f"w{k}" for k in range(60)]
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < toxic_share
        own = rng.choices(words, k=rng.randrange(8, 30))
        own += rng.choices(["vile", "scum"], k=2) if bad else []
        # A group is mentioned mostly in toxic sentences: a correlation that isn't a cause.
        own += ["women"] if rng.random() < (0.6 if bad else 0.02) else []
        rng.shuffle(own)
        texts.append(" ".join(own))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_swaps_stay_in_their_group():
    assert toxicity.swapped("Women and a gay man") == "men and a lesbian woman"
    assert toxicity.swapped("womenfolk") == "womenfolk"


def test_penalty_takes_the_weight_off_identity_terms():
    texts, labels = sentences(random.Random(1), 600)
    z = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit_model(texts, labels, penalty=penalty)
        rows = toxicity._all_rows(["w1 w2 women w3", "w1 w2 men w3", "w1 vile scum"])
        z[penalty] = rows.score(model.weights, model.bias)
    plain, fair = z[0.0], z[20.0]
    assert abs(fair[0] - fair[1]) < abs(plain[0] - plain[1]) / 2
    assert fair[2] > 0 and fair[0] < 0


def plain_loss(texts, labels, model, used, ratio, l2, penalty):
    """The objective by its definition, a text and a pair at a time."""

    def z(text):
        rows = toxicity._all_rows([text])
        return sum(float(v) * float(model.weights[f]) for f, v in zip(rows.feature, rows.value, strict=True)) + model.bias

    own = [z(t) for t in texts]
    loss = sum(np.log1p(np.exp(s)) - y * s for s, y in zip(own, labels, strict=True)) / len(texts)
    pairs = [(s, z(toxicity.swapped(t, turn=turn))) for turn in (1, 2) for t, s in zip(texts, own, strict=True) if toxicity.swapped(t, turn=turn) != t]
    return loss + penalty / len(texts) * sum((a - b) ** 2 for a, b in pairs) + l2 / 2 * sum((model.weights[f] / ratio[f]) ** 2 for f in used)


def test_the_fit_lowers_the_plain_loss():
    """Loss and gradient of the fit equal the definition's: values, and differences along random directions."""
    texts, labels = sentences(random.Random(5), 60)
    fit = toxicity.Fit(texts, labels, penalty=2.0)
    rng = np.random.default_rng(0)
    w, bias = rng.normal(size=len(fit.used)), 0.3
    loss, grad, grad_b = fit.loss(w, bias)
    model = fit.model(w, bias)
    assert np.isclose(loss, plain_loss(texts, labels, model, fit.used, fit.ratio, fit.l2, 2.0), rtol=1e-3)
    for _ in range(3):
        step = rng.normal(size=len(w))
        up, down = (fit.loss(w + e * step, bias + e)[0] for e in (1e-4, -1e-4))
        assert np.isclose((up - down) / 2e-4, grad @ step + grad_b, rtol=1e-3)
    start, end = (plain_loss(texts, labels, m, fit.used, fit.ratio, fit.l2, 2.0) for m in (fit.model(np.zeros(len(w)), 0.0), toxicity.fit_model(texts, labels, penalty=2.0)))
    assert end < start / 2


def test_neutral_mentions_of_a_group(spark):
    """The regularised fit reduces false positives on texts that mention a group and are not toxic."""
    rng = random.Random(4)
    plain = lambda n: rng.choices([f"w{k}" for k in range(60)], k=n)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.5
        # Half the toxic texts have nothing else that tells them but the group that they attack.
        own = plain(8) + (["vile"] if bad and rng.random() < 0.5 else []) + (["women"] if rng.random() < (0.8 if bad else 0.02) else [])
        rows.append((i, " ".join(own), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral, toxic = ([" ".join([*plain(8), w]) for _ in range(200)] for w in ("women", "vile"))
    wrong, caught = {}, {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(docs, known, penalty=penalty)
        wrong[penalty], caught[penalty] = (int((toxicity._all_rows(t).score(model.weights, model.bias) > 0).sum()) for t in (neutral, toxic))
    assert wrong[0.0] > 100 and wrong[20.0] < wrong[0.0] / 2 and caught[20.0] > 150


def test_scores_on_held_out_rows(spark):
    texts, labels = sentences(random.Random(2), 800, 0.3)
    model = toxicity.fit_model(texts[:500], labels[:500])
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts[500:])], "doc_id long, text string, score string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in enumerate(labels[500:])]) > 0.95
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_toxicity_of_odd_rows(spark, documents, nothing):
    labels = spark.createDataFrame([(10, 1), (11, 0), (10, 0), (None, 1), (12, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(documents, labels)
    rows = toxicity.score(documents, model).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert 0 < toxicity.fit_model([], np.array([])).scores(__import__("pyarrow").array(["a"]), np.zeros(3 << 18, bool))[0] < 1


LANGS = {"xa": "kamo lute rani sovu", "xb": "strunk pfelt grosch wimmt", "xc": "ñoé çaïs éléa oùtre"}


def test_language(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choices(LANGS[lang].split(), k=rng.randrange(2, 12))), lang, "s"))
    rows += [(900, None, "xa", "s"), (901, "123 !?", "xa", "s"), (902, "", None, "s"), (903, "kamo " * 5000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs, toxicity.remainder(__import__("pyspark").sql.functions.col("id"), 4) != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predicted(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang, _ in rows[:300])
    assert {got[i] for i in (900, 901, 902)} == {("und", 0.0)} and got[903][0] == "xa"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language_id.predicted(docs, None).collect()} == {"und"}
    assert language_id.fit(docs.filter("false")) is None


def test_rare_contexts_have_states_of_their_own():
    model = language_id.fit_model({"a": ["abracadabra"], "b": ["xyz"]})
    a = int(model.symbols.max()) + 1
    # A text's first bytes have contexts that reach before its start.
    assert (model.states >= a * a).sum() == len({"abr", "bra", "rac", "aca", "cad", "ada", "dab", "^^^", "^^a", "^ab", "^^x", "^xy"})


def plain_code_length(texts, all_texts, text):
    """Prediction by partial matching by its definition, with dictionaries; "" stands before a text's start."""
    alphabet = {b for t in all_texts for b in t} | {""}
    seen = {}
    for t in texts:
        padded = ["", "", "", *t]
        for k in range(3, len(padded)):
            for order in range(4):
                own = seen.setdefault(tuple(padded[k - order : k]), {})
                own[padded[k]] = own.get(padded[k], 0) + 1

    def probability(context, symbol):
        shorter = (lambda s: probability(context[1:], s)) if context else (lambda s: 1 / len(alphabet))
        own = seen.get(context)
        if not own:
            return shorter(symbol)
        total = sum(own.values())
        unseen = sum(shorter(s) for s in alphabet - own.keys())
        escape = len(own) / (total + len(own)) if unseen > 0 else 0
        return own[symbol] / total * (1 - escape) if symbol in own else escape * shorter(symbol) / unseen

    padded = ["", "", "", *(c if c in alphabet else "" for c in text)]
    return -sum(np.log(probability(tuple(padded[k - 3 : k]), padded[k])) for k in range(3, len(padded)))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("abc ", max_size=9), min_size=1, max_size=4), st.lists(st.text("abd", min_size=1, max_size=9), min_size=1, max_size=3), st.text("abcdz ", min_size=1, max_size=12))
def test_code_lengths_match_direct_counts(first, second, text):
    import pyarrow as pa

    model = language_id.fit_model({"x": first, "y": second})
    got = model.code_lengths(pa.array([text, "", text]))
    want = [plain_code_length(own, first + second, text) for own in (first, second)]
    assert np.allclose(got[0], want, rtol=1e-4) and np.allclose(got[2], want, rtol=1e-4) and not got[1].any()


def test_the_model_is_bounded():
    rng = random.Random(1)
    texts = {lang: ["".join(rng.choices("abcdefghij", k=400)) for _ in range(20)] for lang in "xyz"}
    whole, small = language_id.fit_model(texts), language_id.fit_model(texts, model_bytes=20_000)
    assert whole.nats.nbytes > 100_000 and small.nats.nbytes <= 20_000 and small.nats.shape[0] == 3


def test_code_lengths_are_a_distribution():
    """After every context the probabilities of all symbols sum to one, and match a direct count at order 0 to 3."""
    model = language_id.fit_model({"a": ["abracadabra abracadabra"] * 3, "b": ["xyz"]}, least_seen=1)
    for nats in model.nats:
        total = np.exp(-nats.reshape(-1, model.size).astype(float)).sum(axis=1)
        assert np.allclose(total, 1, atol=1e-3)


@pytest.fixture(scope="module")
def tokenizer():
    return encoder(piece_model_path())


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  abeinorst.,\n\t▁é漢😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_tokens_are_the_librarys(tokenizer, text):
    packed = tokenizer.encode(text)
    assert unpacked(packed) == tokenizer.library.encode(text, add_bos=True, add_eos=True)
    assert tokenizer.decode(packed) == tokenizer.library.decode(unpacked(packed))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 16, 17, 33, 100, 1000])
def test_runs_of_spaces(tokenizer, n):
    for text in (" " * n, " " * n + "tion", "a" + " " * n + "\x07", " " * n + "\n" + " " * n):
        assert unpacked(tokenizer.encode(text)) == tokenizer.library.encode(text, add_bos=True, add_eos=True)


def test_edge_checks_are_remerging(tokenizer):
    rng = random.Random(4)
    short = [p for p in tokenizer.halves if len(p) <= 5]
    for _ in range(3000):
        a, b = rng.choice(short), rng.choice(short)
        if "▁" not in b:
            assert tokenizer._fits(a, b) == (tokenizer.merged(a + b) == [a, b])


def test_tokens_of_a_table(documents, corpus, nothing, tokenizer):
    got = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in encoded(documents, piece_model_path()).collect()}
    for i, t in corpus:
        want = tokenizer.library.encode(t or "", add_bos=True, add_eos=True)
        assert unpacked(got[i][0]) == want and got[i][1] == tokenizer.library.decode(want)
    assert encoded(nothing, piece_model_path()).count() == 0


@pytest.fixture(scope="module")
def items(corpus):
    by = dict(corpus)
    words = by[200].split()
    rows = [("a", " ".join(words[50:75])), ("b", " ".join(words[60:69])), ("c", "One TWO"), ("d", None), ("e", "!!"), ("f", "no such words here at all in any text of these"), ("g", by[100]), ("g", by[100]), (None, by[101])]
    return rows


@pytest.mark.parametrize("block", [32 << 20, 100])
def test_contamination(spark, documents, corpus, items, block):
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontaminate.contamination(documents, bench, block_bytes=block).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out}
    assert got == brute.contamination(corpus, [x for x in items if x[0] is not None])


def test_blocks_do_not_change_rows(spark):
    """Rows with null ids stay, and rows that share an id keep their own words and spans."""
    first, second = (" ".join(f"{c}{k}" for k in range(12)) for c in "qz")
    texts = [(None, f"x {first} y"), (None, "short"), (1, first + " " + second), (1, "a"), (1, None), (2, f"{first} . {second} {first}"), (2, f"{first} . {second} {first}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    one, two = (decontaminate.contamination(docs, bench, spans=True, block_bytes=b) for b in (32 << 20, 10))
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.count() == 7
    assert decontaminate.contamination(docs, bench, block_bytes=10).columns == ["doc_id", "n_words", "n_hit", "items"]


def test_removal_spans(spark):
    docs = spark.createDataFrame([(1, "É start " + " ".join(f"q{k}" for k in range(15)) + " end")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"Q{k}" for k in range(15)))], "item_id long, text string")
    row = decontaminate.contamination(docs, bench, spans=True).first()
    raw = "É start " + " ".join(f"q{k}" for k in range(15)) + " end"
    (span,) = row["spans"]
    assert raw.encode()[: span["start"]].decode() + raw.encode()[span["end"] :].decode() == "É start  end"


def test_contamination_of_nothing(spark, documents, nothing, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r["n_hit"], len(r["items"])) for r in decontaminate.contamination(documents, none).collect()} == {(0, 0)}
    assert decontaminate.contamination(nothing, spark.createDataFrame(items, "item_id string, text string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=5), st.lists(st.integers(1, 4), min_size=1, max_size=3))
def test_fm_index(texts, pattern):
    """All occurrences inside texts are found, none across two of them."""
    sequence = np.array([s for t in texts for s in [*t, 0]])
    index = decontaminate.FMIndex.of(sequence, 5, step=3)
    low, high = index.search(np.array([pattern]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [k for k in range(len(sequence)) if sequence[k : k + len(pattern)].tolist() == pattern]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(symbols):
    sequence = np.array([*symbols, 9])
    assert decontaminate.suffix_order(sequence).tolist() == sorted(range(len(sequence)), key=lambda k: sequence[k:].tolist())


def test_an_index_serves_several_benchmarks(spark, documents, corpus, items):
    """Shards hold all words of their texts, are made once, and give what a search of its own gives."""
    shards = decontaminate.built(documents, shard_bytes=4000)
    assert shards.count() > 3
    words = sum(v[0] for v in brute.contamination(corpus, []).values())
    assert sum(np.frombuffer(r["counts"], "<i4").sum() for r in shards.collect()) == words
    for some in (items[:4], items[4:8]):
        bench = spark.createDataFrame(some, "item_id string, text string")
        out = decontaminate.contamination(documents, bench, shards=shards).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out} == brute.contamination(corpus, some)
