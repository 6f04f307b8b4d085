"""Operators against plain Python, libraries, exact round trips or held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lodestow.llm import best_fit_packing, byte_bpe, fingerprints, line_dedup, ngram_join, ppm, quality_rules, queries, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def run(spark, data, name):
    return {r["doc_id"]: r for r in queries.queries()[name](spark, data).collect()}


def test_op1_held_out(spark, data):
    scores = run(spark, data, "op1_quality_classifier")
    rows = [(scores[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{data}/labels.parquet").collect()]
    held = [(s["predicted"], q) for s, q in rows if s["held_out"]]
    assert held and np.mean([p == q for p, q in held]) > 0.9
    assert all(s["held_out"] == (zlib.crc32(str(s["doc_id"]).encode()) % 4 == 2) for s in scores.values())


def test_op2_statistics(spark, data, texts):
    got = run(spark, data, "op2_quality_rules")
    for i, t in texts.items():
        words = WORD.findall(t)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_op3_against_tiktoken(spark, data, texts):
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = {-1: "I'll don't 'tis we'RE 'S 12³ ½  x y 　z\n\n  a\tb \r\n", -2: "日本語 \U0001f600́ ß'd'll", -3: "z" * 3000 + "'s" * 50, -4: "<|endoftext|> x"}
    docs = spark.createDataFrame([*texts.items(), *odd.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, ranks).collect()}
    for i, t in [*texts.items(), *odd.items()]:
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


class PlainTrie:
    """Prediction by partial matching, one symbol at a time."""

    def __init__(self, words, texts):
        self.count = defaultdict(Counter)
        for w, n in words.items():
            self.each(w, lambda ctx, s, n=n: self.count[ctx].update({s: n}))
        for ctx in (b"", b" "):
            self.count[ctx][10] += texts

    @staticmethod
    def each(word, use):
        coded = b" " + word + b" "
        for i in range(1, len(coded)):
            for k in range(min(i, ppm.ORDER) + 1):
                use(coded[i - k : i], coded[i])

    def symbol(self, context, s):
        bits, gone = 0.0, set()
        for k in range(min(len(context), ppm.ORDER), -1, -1):
            node = self.count.get(context[len(context) - k :])
            if node is None:
                continue
            left = {x: c for x, c in node.items() if x not in gone}
            if not left:
                gone |= set(node)
                continue
            total = sum(left.values())
            if s in left:
                return bits + math.log10((2 * left[s] - 1) / (2 * total))
            bits += math.log10(len(left) / (2 * total))
            gone |= set(node)
        return bits - math.log10(257 - len(gone))


def test_op4_small_model(spark):
    train = ["the cat the hat", "a cat and the bat", "", "hat hat THE cat"]
    test = [*train, "the zebra chat", "cats and bats and cats and bats and", "ñ"]
    rows = [(i, t, i < len(train)) for i, t in enumerate(test)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    model = ppm.train(docs)
    got = {r["doc_id"]: r for r in ppm.score(docs.drop("learn"), model).collect()}
    low = [[w.encode() for w in WORD.findall(t.lower())] for t in test]
    words = Counter(w for t in low[: len(train)] for w in t)
    plain = PlainTrie(words, len(train))
    n, v = sum(words.values()) + len(train), len(words) + 1
    assert (model.tokens, model.distinct) == (n, v)
    for i, t in enumerate(low):
        counts = [words[w] for w in t] + [len(train)]
        assert got[i]["n_tokens"] == len(t) + 1 and got[i]["n_known"] == sum(c > 0 for c in counts)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in counts), abs=1e-9)
        total, followed, made, right = 0.0, {}, 0, 0
        for k, w in enumerate([*t, None]):
            price = 0.0
            if w is None:
                price = plain.symbol(b" ", 10)
            else:
                coded = b" " + w + b" "
                price = sum(plain.symbol(coded[:j], coded[j]) for j in range(1, len(coded)))
            before = tuple(t[k - 2 : k]) if k > 1 else None
            if before in followed:
                p = (right + 0.5) / (made + 1)
                hit = followed[before] == w
                price = math.log10(p) if hit else price + math.log10(1 - p)
                made, right = made + 1, right + hit
            if before:
                followed[before] = w
            total += price
        assert got[i]["score"] == pytest.approx(total, abs=1e-6), test[i]


def test_op4_folds(spark, data, texts):
    got = run(spark, data, "op4_ppm")
    counts, n = Counter(), 0
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*WORD.findall(t.translate(low)), None] for i, t in texts.items()}
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)


def test_op5_restores_disguises(spark, data):
    plain = spark.createDataFrame([(0, "you idiot clown are stupid and worthless trash")] * 50, "doc_id long, text string")
    log = toxicity.train_characters(plain.union(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")))
    r = toxicity.Restorer(log)
    for given, want in {"an 1d10t": "an idiot", "st-u-p-i-d": "st-u-p-i-d", "s t u p i d": "stupid", "cl0wn!": "clown!", "trrrrash": "trash", "w.o.r.t.h.l.e.s.s": "worthless", "plain words 12 stay": "plain words 12 stay"}.items():
        assert r(given) == want
    scores = run(spark, data, "op5_toxicity")
    assert all(0 <= s["score"] <= 1 and s["predicted"] == (s["score"] >= 0.3) for s in scores.values())


def test_op6_edits_and_fingerprints(spark, data, texts):
    got = run(spark, data, "op6_fingerprints")
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, following = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    for text in set(texts.values()):
        assert len({got[i]["fingerprint"] for i, t in texts.items() if t == text}) == 1
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.95


def plain_print(text):
    """SimHash of five-word shingles, each hashed word by word on the hash before."""
    import xxhash

    words = [w for w in WORD.findall(text)]
    votes, n = [0] * 64, 0
    for k in range(max(len(words) - 4, min(len(words), 1))):
        h = 42
        for w in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        n += 1
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > n)


def plain_fingerprints(rows):
    """The query by hand: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near), sorted."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    near = lambda d: 1.0 if d == 0 else max(0.0, math.cos(math.pi * d / 64))
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    prints = [plain_print(t) for _, t in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        cut = len(t) // 3
        edited = t[: len(t) - cut] + rows[n][1][:cut]
        e = plain_print(edited)
        among = sum((prints[k] ^ x).bit_count() <= 3 for x in prints) - 1 if i is not None and i % 100 == 0 else None
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[k]:016x}", f"{e:016x}", near((prints[k] ^ e).bit_count()), near((prints[k] ^ prints[n]).bit_count()), among))
    return sorted(out, key=str)


def test_op6_whole_query_from_text(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    ids = sorted(set(rng.integers(-(1 << 62), 1 << 62, 80).tolist() + [-(1 << 63), (1 << 63) - 1, 0, *range(100, 4100, 100)]), reverse=True)
    base = " ".join(words)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in ids]
    rows += [(100, "another text of one id"), (100, "another text of one id"), (100, "another text of one id"), (None, "no id"), (None, "no id"), (None, None), (None, "none either"), (300, ""), (300, None)]
    rows += [(5000 + k, base + f" more {k % 3}" * (k % 4)) for k in range(0, 600, 50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(fingerprints.fingerprint_documents, "__defaults__", (7,))  # many ranges of ids
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"]
    got = sorted((tuple(r[n] for n in names) for r in fingerprints.op6_fingerprints(spark, str(tmp_path)).collect()), key=str)
    want = plain_fingerprints(rows)
    assert [g[:5] + g[7:] for g in got] == [w[:5] + w[7:] for w in want]
    assert np.allclose([g[5:7] for g in got], [w[5:7] for w in want], atol=1e-12)
    assert max(w[7] or 0 for w in want) > 1


def test_op6_votes_and_radius(spark):
    rng = np.random.default_rng(5)
    hashes = {0: [], 1: rng.integers(-(1 << 63), 1 << 63, 5).tolist(), 2: rng.integers(-(1 << 63), 1 << 63, 40_000).tolist()}
    got = {r["id"]: r["fingerprint"] for r in fingerprints.simhash(spark.createDataFrame(list(hashes.items()), "id long, terms array<long>"), ["id"]).collect()}
    for i, h in hashes.items():
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i] & (1 << 64) - 1 == bits
    base = rng.integers(-(1 << 63), 1 << 63, 60).tolist()
    prints = base + [x ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in [rng.choice(63, 2, replace=False)]]
    df = spark.createDataFrame([(int(x),) for x in prints], "fingerprint long")
    found = {(r["query"], r["found"]) for r in fingerprints.within_radius(df, df, 3).collect()}
    want = {(a, b) for a in set(prints) for b in set(prints) if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == want and want


def test_op7_packs_everything(spark, data, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = queries.queries()["op7_best_fit_packing"](spark, data).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    total = 0
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert k == 0 or r["length"] == 1024 or len(ids) <= 1024
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
    assert len(sequences) <= 1.02 * math.ceil(total / 1024) + 1


def test_op7_capacities():
    lengths = np.array([900, 500, 500, 20, 10, 5, 1])
    cap = best_fit_packing.Capacity(tokens=1024, documents=3, attention=850_000)
    for rule in ("norm", "dot"):
        bins, offsets = best_fit_packing.pack(lengths, best_fit_packing.Capacity(cap.tokens, cap.documents, cap.attention, cap.weights, rule))
        for b in set(bins):
            own = lengths[bins == b]
            assert own.sum() <= 1024 and len(own) <= 3 and ((own**2).sum() <= 850_000 or len(own) == 1)


def plain_dedup(docs):
    """Every document's text after later occurrences of three-line windows are gone."""
    lines = {i: [(k, x.strip("\t\n\x0b\x0c\r ")) for k, x in enumerate(t.split("\n"))] for i, t in docs.items()}
    full = {i: [x for x in v if x[1]] for i, v in lines.items()}
    first = {}
    for i in sorted(full):
        for p in range(len(full[i]) - 2):
            first.setdefault(tuple(x[1] for x in full[i][p : p + 3]), (i, p))
    out = {}
    for i, v in full.items():
        gone = set()
        for p in range(len(v) - 2):
            at = first[tuple(x[1] for x in v[p : p + 3])]
            if at != (i, p):
                gone |= {v[k][0] for k in range(max(p, at[1] + 3) if at[0] == i else p, p + 3)}
        out[i] = "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in gone)
    return out


def test_op8_against_plain(spark, texts):
    small = {1: "a\nb\nc\nd", 2: "x\na\nb\nc\ny", 3: "b\nc\nd", 4: "q\nq\nq\nq\nq", 5: "a\n\n b \nc", 6: "only\ntwo", 7: "a\nb\nc\nd\na\nb\nc\nd"}
    for docs in (small, texts):
        got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
        want = plain_dedup(docs)
        assert {i: r["text"] for i, r in got.items()} == want
        assert all(r["n_lines"] == (len(docs[i].split("\n")) if docs[i] else 0) for i, r in got.items())


def plain_links(docs):
    sets = {}
    for t in set(docs.values()):
        w = WORD.findall(t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    names = list(sets)
    where = defaultdict(list)
    for k, t in enumerate(names):
        for g in sets[t]:
            where[g].append(k)
    for k, t in enumerate(names):
        for o, n in Counter(o for g in sets[t] for o in where[g] if o != k).items():
            if n >= 0.8 * (len(sets[t]) + len(sets[names[o]]) - n) - 1e-9:
                links[t].add(names[o])
    return links


def test_op9_against_plain(spark, texts):
    rng = np.random.default_rng(3)
    docs = dict(texts)
    words = [f"w{i}" for i in range(400)]
    origin = [words[k] for k in rng.integers(0, 400, 150)]
    for i in range(60):  # a group of near copies of one text, more and less like each other
        w = list(origin)
        for k in rng.choice(150, rng.integers(0, 4), replace=False):
            w[k] = f"new{i}_{k}"
        docs[10_000 + i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    links = plain_links(docs)
    label = {}
    for i in sorted(docs):
        if i in label:
            continue
        stack, seen = [docs[i]], {docs[i]}
        while stack:
            for t in links[stack.pop()] - seen:
                seen.add(t)
                stack.append(t)
        label |= {k: i for k, t in docs.items() if t in seen}
    before = ngram_join.BLOCK
    try:
        for block in (before, 16):  # in one task for each bucket, and in pairs of blocks
            ngram_join.BLOCK = block
            got = {r["doc_id"]: r for r in ngram_join.near_duplicates(df, recall=0.999999).collect()}
            assert {i: r["class_id"] for i, r in got.items()} == label
            assert {i: r["n_links"] for i, r in got.items()} == {i: len(links[t]) for i, t in docs.items()}
    finally:
        ngram_join.BLOCK = before


def test_op9_banding():
    bands, rows = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= ngram_join.ROWS


def test_op10_accuracy(spark, data):
    got = queries.queries()["op10_language_id"](spark, data).collect()
    docs = [r for r in got if r["doc_id"] is not None]
    assert len(docs) + sum(r["page_id"] is not None for r in got) == len(got)
    assert np.mean([r["language"] == r["declared"] for r in docs]) > 0.97
    assert np.mean([r["accepted"] for r in docs]) > 0.97


def test_op10_evidence_decides_where_text_is_silent(spark):
    from lodestow.llm import language_id as L

    words = {"en": "the and of with this that from", "de": "der und von mit diese das aus"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(words[k].split() * 4)), k, None, f"{k}.example") for k in words for i in range(60)]
    rows += [(1000, "qqq", "de", None, "de.example"), (1001, "zzz", None, None, "de.example"), (1002, "zzz", None, None, "en.example"), (1003, "der und von mit diese das aus der und", "en", None, "en.example")]
    e = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {r["id"]: r["language"] for r in L.identify(e, L.train_text_model(e)).where("id >= 1000").collect()}
    assert got == {1000: "de", 1001: "de", 1002: "en", 1003: "de"}


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


PAIRS = [tuple(thue_morse(n, *ab) for ab in ((a, b), (b, a))) for n in (1024, 2048, 4096) for a, b in ("ab", "01", "th")]


def test_texts_that_differ_have_different_keys(spark):
    """Words that a polynomial hash takes for one, through every operator that tells words apart."""
    import tiktoken
    from tokenizers import Tokenizer

    from lodestow.llm import text_arrays

    for x, y in PAIRS:
        buf = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
        starts, ends, _ = text_arrays.runs(buf, np.array([0, len(buf)]))
        h = text_arrays.hashes(buf, starts, ends)
        assert h[0] == h[2] != h[1]
        assert text_arrays.same(buf, starts[[0, 0]], ends[[0, 0]], starts[[1, 2]], ends[[1, 2]]).tolist() == [False, True]
        text = f"{x}\n{y}\n{x}"
        stats, _, _ = quality_rules.statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert stats["n_dup_lines"].tolist() == [1]
        grams = [g.tolist() for _, _, g, _ in ngram_join.gram_sets(text_arrays.pa.array([x, y, x]))][0]
        assert len(set(grams)) == 2
    texts = {i: f"{x} {y} {x}\n{y}" for i, (x, y) in enumerate(PAIRS)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.round_trip(docs, ranks).collect():
        ids = np.array(library.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["ids_sha256"], r["decoded_sha256"]) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        vocabulary = f.read()
    tokenizer = Tokenizer.from_str(vocabulary)
    for r in best_fit_packing.pieces(docs, vocabulary, 1 << 20).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4"))
    model = ppm.train(docs.withColumn("learn", docs.doc_id % 3 == 0))
    words = Counter(w for i, t in texts.items() if i % 3 == 0 for w in [*t.split(), None])
    assert (model.tokens, model.distinct) == (sum(words.values()), len(words))
    assert {r["doc_id"]: r["n_known"] for r in ppm.score(docs, model).collect()} == {i: sum(w in words for w in [*t.split(), None]) for i, t in texts.items()}


def test_equal_hashes_are_held_against_the_bytes(monkeypatch):
    """With a hash that takes all for one, pre-tokens and lines are still told apart."""
    from lodestow.llm import text_arrays

    text = "one two\none  two\n three\none two\n three"
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    merger = byte_bpe.Merger(ranks)
    encode = lambda: [ids.tolist() for _, _, ids, _ in byte_bpe.Encoder(lambda p: list(map(merger, p))).rows(text_arrays.pa.array([text, "x"]))]
    want = encode()
    monkeypatch.setattr(text_arrays, "hashes", lambda buf, starts, ends, folded=False: np.zeros(len(starts), np.uint64))
    assert encode() == want
    stats, _, _ = quality_rules.statistics(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert stats["n_dup_lines"].tolist() == [2]
