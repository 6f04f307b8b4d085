"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns: every operator has a result."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestow.llm import best_fit_packing, byte_bpe, fingerprints, language_id, line_dedup, linear, ngram_join, ppm, quality_classifier, quality_rules, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my".split()
LONG = " ".join(WORDS[(i * i) % 12] + str(i % 97) for i in range(60_000))
BASE = " ".join(f"{WORDS[i % 12]}{i}" for i in range(80))
ROWS = [
    (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \n\t ", None, None), (None, "no id at all here", "fr", "s1"), (None, None, None, None),
    (4, BASE, "en", "s0"), (4, BASE, "en", "s0"), (5, BASE + " more", "de", "s1"), (6, BASE, "en", "s2"), (4, "same id, other text", "en", "s0"),
    (7, LONG, "en", "s0"), (8, "a", "en", "s0"), (9, "x\n\ny\nz\n\nx\ny\nz", "en", "s0"), (10, "ÀÉ ñandú 日本語 \U0001f600 don't  1 2", "es", "s1"), (-11, "y" * 5000, "en", "s1"),
]
CLASH = ["key", "node", "row", "bucket", "score", "h", "w", "gone", "_id", "_key", "learn", "band", "at", "copy", "nth", "p", "id", "label", "place", "spans", "chunk", "n", "y", "declared", "host"]


def documents(spark, rows):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    return documents(spark, ROWS if request.param == "odd" else [])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 11)] + [(None, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").select("*", F.lit(1).alias("text"), F.lit(1).alias("y"))


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


def want(docs):
    return ids(docs.select("doc_id").collect())


def test_quality(docs, labels):
    got = quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, labels)).collect()
    assert ids(got) == want(docs) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_classifier.score_quality(docs, quality_classifier.train_quality(docs, labels.limit(0))).collect()
    assert all(r["score"] == 0.5 for r in none)
    got = quality_rules.apply_rules(docs, quality_rules.train_rules(docs, labels)).collect()
    assert ids(got) == want(docs) and all(r["base_failed"] for r in got if r["n_words"] == 0)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_toxicity(docs, labels):
    log = toxicity.train_characters(docs)
    got = toxicity.score_toxicity(docs, log, toxicity.train_toxicity(docs, labels, log)).collect()
    assert ids(got) == want(docs) and all(0 <= r["score"] <= 1 for r in got)
    restored = {r["doc_id"]: r["restored"] for r in toxicity.restore(docs, log).collect()}
    assert not restored or restored[1] is None and restored[2] == ""


def test_tokens(docs):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = byte_bpe.round_trip(docs, ranks).collect()
    assert ids(got) == want(docs)
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks), ranks).select("bytes").collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted((r["text"] or "").encode() for r in docs.collect())


def test_packing(docs):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        got = best_fit_packing.pack_documents(docs, f.read()).collect()
    assert sorted({str(r["doc_id"]) for r in got}) == sorted({str(x) for x in want(docs)})
    seen = {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_fingerprints(docs):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert ids(got) == want(docs)
    assert len({r["fingerprint"] for r in got if r["n_chars"] == len(BASE)}) <= 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_lines(docs):
    got = line_dedup.dedup_lines(docs).collect()
    assert ids(got) == want(docs)
    if got:
        assert [(r["text"], r["n_removed"]) for r in got if r["doc_id"] == 9] == [("x\n\ny\nz\n", 3)]
        assert [r["text"] for r in got if r["doc_id"] in (1, 2)] in ([None, ""], ["", None])


def test_near_duplicates(docs):
    got = ngram_join.near_duplicates(docs).collect()
    assert ids(got) == want(docs)
    if got:
        by = {(r["doc_id"], r["text_key"]): r for r in got}
        groups = {k: r["class_id"] for k, r in by.items()}
        assert sorted(r["n_links"] for r in got if r["class_id"] == 4 and r["first_copy"] in (4, 5)) == [0, 1, 1, 1, 1]
        assert sum(v == 1 for v in groups.values()) == 3  # null and empty texts are copies: ids 1, 2 and null
        assert [r["n_copies"] for k, r in by.items() if k[0] == 6] == [3]


def test_languages(docs, spark):
    pages = spark.createDataFrame([(1, "http://h.example.org/a", '<html lang="EN-gb"><script>x</script><p>some words of text</p>'), (2, None, None)], "page_id long, url string, html string").where(docs.count() > 0 and "true" or "false")
    got = language_id.identify_documents(docs, pages).collect()
    assert sorted((r["id"] for r in got), key=str) == want(docs)
    assert not any(r["accepted"] for r in got if r["id"] in (1, 2, 3))
    found = language_id.evidence_of_pages(pages).collect()
    assert [(r["declared"], r["host"], r["suffix"]) for r in found if r["id"] == 1] in ([("en", "h.example.org", "org")], [])


def test_language_model(docs):
    model = ppm.train(docs.withColumn("learn", F.lit(True)))
    got = ppm.score(docs, model).collect()
    assert ids(got) == want(docs)
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 3)) and all(r["score"] < 0 for r in got)
    assert all(r["n_known"] == r["n_tokens"] for r in got)
    nothing = ppm.score(docs, ppm.train(docs.withColumn("learn", F.lit(False)))).collect()
    assert all(r["n_known"] == 0 and np.isfinite(r["base_score"]) and np.isfinite(r["score"]) for r in nothing)


def test_sample_is_bounded_and_keeps_out_the_fold(docs, labels):
    got = linear.labelled_sample(docs, labels, "quality", 2, per_class=2).collect()
    assert {r["y"] for r in got} <= {0, 1}
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in got)


def test_word_counts_do_without_grams(spark):
    from lodestow.llm import ppm

    docs = spark.createDataFrame([(1, "one two One", True), (2, "two three", True), (3, None, False), (4, "one four", False)], "doc_id long, text string, learn boolean")
    few, full = ppm.train(docs, across=True, spelled=False), ppm.train(docs, across=True)
    assert {r["kind"] for r in few.counts.collect()} == {0}
    base = [[tuple(r) for r in ppm.score(docs, m).select("doc_id", "n_tokens", "n_known", "base_score").orderBy("doc_id").collect()] for m in (few, full)]
    assert base[0] == base[1] and len(base[0]) == 4
