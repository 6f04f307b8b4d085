"""Inputs on which a cut of the work would show: many rare contexts, order of words, unusual disguises, rare languages."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestow.llm import ppm, toxicity
from test_brute_force import PlainTrie


def test_op4_keeps_rare_contexts_of_a_large_table(spark):
    rng = np.random.default_rng(3)
    often = rng.choice(26, (1000, 8)) + 97
    once = rng.choice(26, (400_000, 8)) + 97
    words = [bytes(w).decode() for w in np.concatenate([np.repeat(often, 20, 0), once]).astype(np.uint8)]
    rows = [(i, " ".join(words[i::40]), True) for i in range(40)] + [(99, " ".join(words[-500:]), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(4)
    got = {r["doc_id"]: r for r in ppm.score(docs, ppm.train(docs)).collect()}
    assert got[99]["n_known"] == 501
    # five letters tell nearly every word: the rest costs about half a letter's share each, not log10(1 / 26)
    assert got[99]["score"] / 500 > -8.5


def test_op4_tells_prose_from_word_salad(spark):
    """The query's model, by hand and by the order of words: no two words are repeated after the same two within a text."""
    prose = ["the old man sat on a red mat", "a red mat lay on the old floor", "the old man saw a cat"] * 5
    salad = "mat the on a sat red man old"
    rows = [(i, t, True) for i, t in enumerate(prose)] + [(100, prose[0], False), (101, salad, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, ppm.train(docs, across=True)).where("doc_id >= 100").collect()}
    trie = PlainTrie({}, 0)
    trie.count.clear()

    def coded(t):
        text = b" " + t.encode() + b" \n"
        return [(text[max(0, i - ppm.ORDER) : i], text[i]) for i in range(1, len(text))]

    for t in prose:
        for context, symbol in coded(t):
            for k in range(len(context) + 1):
                trie.count[context[len(context) - k :]][symbol] += 1
    for i, t in ((100, prose[0]), (101, salad)):
        assert got[i] == pytest.approx(sum(trie.symbol(c, s) for c, s in coded(t)), abs=1e-6)
    assert got[100] - got[101] > 5


def test_op4_query_reads_contexts_across_words(spark, tmp_path):
    held, learnt = ([i for i in range(200) if (zlib.crc32(str(i).encode()) % 5 == 1) == x] for x in (True, False))
    prose = ["the old man sat on a red mat", "a red mat lay on the old floor", "the old man saw a cat"]
    rows = [(i, prose[k % 3]) for k, i in enumerate(learnt)] + [(held[0], prose[0]), (held[1], "mat the on a sat red man old")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in ppm.op4_ppm(spark, str(tmp_path)).collect()}
    assert got[held[0]] - got[held[1]] > 5


def test_op5_restores_long_and_spread_passages(spark, data):
    plain = spark.createDataFrame([(0, "you idiot clown are stupid and worthless trash")] * 50, "doc_id long, text string")
    r = toxicity.Restorer(toxicity.train_characters(plain.union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"))))
    cases = {
        "s - t - u - p - i - d": "stupid", '"s.t.u.p.i.d"': '"stupid"', "[s.t.u.p.i.d]": "[stupid]", "s\tt\tu\tp\ti\td": "stupid", "s\nt\nu\np\ni\nd": "stupid",
        "s/t/u/p/i/d": "stupid", "s,t,u,p,i,d": "stupid", "an id" + "i" * 70 + "ot": "an idiot", "/".join(["1d10t"] * 20): " ".join(["idiot"] * 20), "st-u-p-i-d": "st-u-p-i-d",
        "an idi\u043et": "an idiot", "\uff49\uff44\uff49\uff4f\uff54": "idiot", "\u0455tupid!": "stupid!", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440": "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440",
    }
    assert {given: r(given) for given in cases} == cases
    assert r("/".join(["1d10t"] * 20_000)).count("idiot") == 20_000


def test_op1_weights_by_hand(spark):
    """Follow-the-regularised-leader, one coordinate at a time, and scores as dot products."""
    from lodestow.llm import linear, quality_classifier

    rng = np.random.default_rng(2)
    size, alpha, beta, l1, l2, epochs, seed = 30, 0.3, 1.0, 0.05, 0.01, 3, 7
    idx = [np.sort(rng.choice(size, rng.integers(0, 6), replace=False)) for _ in range(40)]
    val = [rng.random(len(i)) * 3 for i in idx]
    y = rng.integers(0, 2, 40).astype(float)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        if i == size:  # the bias is not regularised
            return -z[i] / ((beta + n[i] ** 0.5) / alpha)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.arange(40)
    shuffle = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        shuffle.shuffle(order)
        for k in order:
            x = [*zip(idx[k].tolist(), val[k].tolist()), (size, 1.0)]
            w = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y[k]) * v
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    got = linear.ftrl(idx, val, y, size, alpha, beta, l1, l2, epochs, seed)
    assert got == pytest.approx([weight(i) for i in range(size + 1)], abs=1e-12)
    texts = ["good words here", "bad bad bad", "", None, "good " * 5000]
    w = rng.normal(size=(1 << quality_classifier.BITS) + 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score_quality(docs, w).collect()}
    import pyarrow as pa

    for k, (i, v) in enumerate(quality_classifier.features(pa.array([t or "" for t in texts]))):
        assert scores[k] == pytest.approx(1 / (1 + np.exp(-(np.float32(w[:-1])[i] @ v + w[-1]))), abs=1e-5)


def test_op2_verdicts_on_held_out_rows(spark, data):
    from lodestow.llm import quality_rules

    got = {r["doc_id"]: r for r in quality_rules.op2_quality_rules(spark, data).collect()}
    rows = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    judged = [(g["kept"], q) for g, q in rows if not g["base_failed"]]
    assert judged and np.mean([k == (q == 1) for k, q in judged]) > 0.9
    assert all(g["kept"] == (not g["base_failed"] and g["probability"] >= 0.5) for g in got.values())


def test_op2_calibration_lowers_the_loss():
    from lodestow.llm import linear

    rng = np.random.default_rng(4)
    z = rng.normal(size=2000) * 5
    y = (rng.random(2000) < linear.sigmoid(0.4 * z - 1)).astype(float)
    a, b = linear.platt(z, y)
    assert a == pytest.approx(0.4, abs=0.05) and b == pytest.approx(-1, abs=0.15)
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert loss(linear.sigmoid(a * z + b)) < loss(linear.sigmoid(z)) - 0.1
    for few in (0, 1, 3, 5):  # at any size
        assert np.isfinite(linear.platt(z[:few], y[:few])).all()


def test_op5_decoding_is_the_best_of_all_paths():
    """Viterbi against every path of the lattice."""
    import itertools

    rng = np.random.default_rng(8)
    r = toxicity.Restorer(np.log(rng.dirichlet(np.ones(28), (28, 28))))
    state = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27

    def cost(path):
        p = q = 0
        total = 0.0
        for c, emitted in [*path, (0.0, " ")]:
            total += c
            for x in emitted:
                k = state(x)
                if k or q:
                    total += r.log[p][q][k]
                    p, q = q, k
        return total

    for passage in ("1d10t", "s.t.u.p", "l00k", "gooood", "a  b c", "b1g $8!t", "w0rrr1d", "x1|1x", "ñ0ñ"):
        paths = list(itertools.product(*r._lattice(passage)))
        want = max(map(cost, paths))
        got = r.decode(passage)
        assert any(" ".join("".join(e for _, e in p).split()) == got and cost(p) == pytest.approx(want, abs=1e-9) for p in paths), passage


LARGER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs more rows")
def test_op5_held_out(spark, data=LARGER):
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, data).collect()}
    rows = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    held = [(g["predicted"], t) for g, t in rows if g["held_out"]]
    assert held and np.mean([p == t for p, t in held]) > 0.9


def test_op9_recall_at_the_registered_setting(spark):
    """Links found between rows whose id is divisible by 100 and all rows, of those that brute force finds."""
    from lodestow.llm import ngram_join
    from test_brute_force import plain_links

    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(3000)]
    docs = {}
    for family in range(120):
        base = [words[k] for k in rng.integers(0, 3000, 200)]
        for copy in range(5):
            w = list(base)
            for k in rng.choice(200, rng.integers(1, 5), replace=False):  # five shingles a change: similarities about 0.8 to 0.95
                w[k] = f"n{family}_{copy}_{k}"
            docs[family * 100 + copy] = " ".join(w)
    links = plain_links(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(df).collect()}
    asked = [i for i in docs if i % 100 == 0]
    want = sum(len(links[docs[i]]) for i in asked)
    assert want > 150 and sum(got[i]["n_links"] for i in asked) >= 0.9 * want
    assert all(got[i]["n_links"] <= len(links[docs[i]]) for i in docs)


def test_op10_fusion_by_hand(spark):
    """Posteriors from the scores of the texts: declarations, suffixes and hosts counted and smoothed in plain Python."""
    from lodestow.llm import language_id as L

    rng = np.random.default_rng(6)
    words = {"en": "the and of with this that from", "de": "der und von mit diese das aus"}
    rows = []
    for i in range(120):
        k = ("en", "de")[i % 2]
        text = " ".join(rng.permutation((words[k] + " " + words["en"]).split())) if i % 7 else "zzz q"
        rows.append((i, text, k if i % 5 else ("de", None)[i % 2], ("org", "de", None)[i % 3], (f"h{i % 4}", None)[i % 6 == 0]))
    e = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    model = L.train_text_model(e)
    names = model.languages
    scored = {r["id"]: r for r in L._text_scores(e, model).collect()}
    got = {r["id"]: r for r in L.identify(e, model).collect()}
    p = {i: np.array(s["p"]) for i, s in scored.items()}
    corpus = sum(p.values())
    everywhere = (corpus + 1) / (corpus.sum() + len(names))
    by = lambda col, v: sum((p[r[0]] for r in rows if r[col] == v), np.zeros(len(names)))
    smooth = lambda c, t: (c + L.PRIOR_ROWS * t) / (c.sum() + L.PRIOR_ROWS)
    for i, _, declared, suffix, host in rows:
        prior = everywhere if suffix is None else smooth(by(3, suffix), everywhere)
        if host is not None:
            prior = smooth(np.maximum(by(4, host) - p[i], 0), prior)
        z = np.array(scored[i]["loglik"]) + np.log(prior)
        if declared is not None:
            z = z + np.log((by(2, declared) + 2 / len(names)) / (corpus + 2))
        post = np.exp(z - z.max())
        post /= post.sum()
        assert (got[i]["language"], got[i]["probability"]) == (names[post.argmax()], pytest.approx(post.max(), abs=1e-9))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs more rows")
def test_op10_reads_the_text_where_nothing_is_declared(spark, data=LARGER):
    """Every second row is left without its declaration: its language is told all the same."""
    from lodestow.llm import language_id as L

    e = L.evidence_of_documents(spark.read.parquet(f"{data}/documents.parquet"))
    hidden = e.withColumn("said", F.col("declared")).withColumn("declared", F.when(F.col("id") % 2 == 0, F.col("declared")))
    got = {r["id"]: r for r in L.identify(hidden, L.train_text_model(hidden)).collect()}
    rows = [(got[r["id"]], r["declared"]) for r in e.where("id % 2 = 1 and declared is not null").collect()]
    assert np.mean([g["text_language"] == d for g, d in rows]) > 0.97 and np.mean([g["language"] == d for g, d in rows]) > 0.97


def test_op10_every_declared_language_counts(spark):
    """Seventy languages, one of them with 25 of many rows, have a model; rows of one that has none are kept."""
    from lodestow.llm import language_id as L

    rng = np.random.default_rng(9)
    tags = [a + b for a in "abcdefg" for b in "abcdefghij"]
    vocabulary = {t: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for t in tags}
    rows = [(i * 1000 + k, " ".join(rng.choice(vocabulary[t], 20)), t, None, None) for i, t in enumerate(tags) for k in range(3000 if i == 0 else 25)]
    rows += [(-1, "quite other words of a tongue of its own", "zz", None, None), (-2, " ", "zz", None, None)]
    e = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    model = L.train_text_model(e)
    assert model.languages == sorted(tags)
    got = {r["id"]: r for r in L.identify(e, model).collect()}
    assert np.mean([got[i]["language"] == t for i, _, t, _, _ in rows if i >= 0]) > 0.98
    assert (got[-1]["language"], got[-1]["accepted"], got[-2]["accepted"]) == ("zz", True, False)


def test_texts_of_millions_of_characters(spark):
    """Long texts are cut into segments for encoding only where a pre-token starts."""
    import hashlib

    import public_tokenizers
    import tiktoken

    from lodestow.llm import byte_bpe

    rng = np.random.default_rng(1)
    parts = np.array(["word", "don't", "  two", "\n\n", "12ab", "ñandú", "日本", "—", "x" * 50, "'s", "!?"])
    texts = {1: " ".join(rng.choice(parts, 400_000)), 2: "a" * 1_300_000, 3: " ".join(rng.choice(parts[:3], 300_000)) + "\n" * 5}
    assert all(len(t) > 1_200_000 for t in texts.values())
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ranks).collect()}
    for i, t in texts.items():
        ids = np.array(library.encode_ordinary(t) if i != 2 else library.encode_ordinary(t), "<u4")
        assert (got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_labels_that_disagree_and_ids_that_repeat(spark):
    from lodestow.llm import linear

    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (3, "c"), (5, None), (7, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (3, 1), (5, 0), (7, 0)], "doc_id long, quality int")
    got = sorted((r["doc_id"], r["text"], r["y"]) for r in linear.labelled_sample(docs, labels, "quality", 9, 10).collect() if r["text"])
    assert got == [(1, "a", 1), (7, "d", 0)]


def test_encoders_that_forget_give_the_same_ids():
    """Pre-tokens are forgotten and met again; two of one hash are told apart."""
    import public_tokenizers
    import pyarrow as pa

    from lodestow.llm import byte_bpe

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    merger = byte_bpe.Merger(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    merge = lambda pieces: list(map(merger, pieces))
    whole = [i for _, _, ids, _ in byte_bpe.Encoder(merge).rows(pa.array(texts)) for i in ids.tolist()]
    for keep in (0, 40, 250):
        encoder = byte_bpe.Encoder(merge, keep)
        assert [i for t in texts for _, _, ids, _ in encoder.rows(pa.array([t])) for i in ids.tolist()] == whole
        assert len(encoder.known.hashes) <= keep + 60
    known = byte_bpe.Known()
    buf = np.frombuffer(b"onetwo", np.uint8)
    h, lo, hi = np.array([5, 5], np.uint64), np.array([0, 3]), np.array([3, 6])
    known.add(h, [b"one", b"two"], [[1], [2]])
    assert known.find(h, buf, lo, hi).tolist() == [0, -1] and known.ids.tolist() == [1]
