"""Language-model scoring by prediction by partial matching over bytes, pretrained on the corpus.

A text is its words (runs of bytes other than space and 0x09-0x0D, with A-Z as a-z) and one end.  The model
codes each word's bytes and a space after them, and the end as a line feed where a word could start.  The
context of a byte is the ORDER bytes before it, those of earlier words included; a text begins after a space.
Without ``across`` each word begins anew, so what it costs does not depend on where it stands.  Contexts form
a trie of counts over all training texts.  A byte is coded in the longest context that the trie has; a context that has not met the byte escapes to the
next shorter one with probability q / 2T (q different bytes met, T in all; a byte met c times has
(2c - 1) / 2T), where the bytes that the longer one has met are excluded; behind the empty context all bytes
not yet excluded are equally likely.  Before all that comes a context that adapts to the text itself: where
the two words before a word have stood together earlier in the text, the word that followed them then is
predicted, with the share of such predictions that have come true in this text so far ((right + 1/2) /
(made + 1)); a wrong one escapes to the trie.

The base score is that of a unigram model with counts of all words, told apart by 64-bit hashes.  Words and
grams (a byte with its longest context) meet their counts by buckets: a task holds one bucket's counts and
streams through what the texts ask of it.  All grams of the training texts are counted, however many; a bucket has all grams whose
contexts end in the same NEAR bytes, so it finds the counts of all its longer contexts by sums, and those of the
shorter ones (at most 2^24 + 2^16 + 2^8, constant) come along as rows.

Null is the empty text: it has one token, the end.  Rows with null ids learn.  Repeated rows are rows of
their own.  Without any training text nothing is known and every byte is equally likely.  Extra columns of
the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_arrays as A
from .common import prepare, table, written
from .linear import fold

ORDER = 6
#: Contexts of fewer bytes than NEAR go to every bucket of grams, longer ones to the bucket of their nearest NEAR bytes.
NEAR = 3
#: Bytes of text in a chunk, and of those that are gone through at once; words or grams that a task counts before it hands them on.
CHUNK, PIECE, FLUSH = 5 << 20, 1 << 19, 1_500_000
#: Of a bucket, about: words, grams, and bytes of training text whose keys are merged at once; bytes of questions for a task.
BUCKET_WORDS, BUCKET_GRAMS, BUCKET_BYTES, TASK_BYTES = 1_000_000, 400_000, 4 << 20, 32 << 20
HELD_OUT, FOLDS = 1, 5

_SPACE, _END, _SYMBOLS = 0x20, 0x0A, 257
#: The hash that stands for the end.
END = A.mix(np.array([0xE0F], np.uint64))[0]
#: The lowest bytes of a context, by how many.
_LOWEST = (np.int64(1) << 8 * np.arange(ORDER + 1)) - 1


def _key(context, order, symbol):
    """One integer for a context of ``order`` bytes, the nearest lowest, and a symbol."""
    return ((context & _LOWEST[order]) << 8 | symbol) << 3 | order


def coded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """The grams of texts as they are coded (symbols with their longest contexts, as keys), and how many each token has.

    A text's tokens are its words and its end.  ``across``: contexts go on over the words before.
    """
    size = np.insert(ends - starts + 1, first[1:], 1)
    upto = np.cumsum(size)
    closing = first[1:] + np.arange(len(first) - 1)
    n = int(upto[-1])
    inside = np.ones(n, bool)
    inside[upto - 1] = False
    # the symbols behind a word's length of others, so that each one's context ends where it stands
    laid = np.full(n + 7, _SPACE, np.uint8)
    symbol = laid[7:]
    symbol[inside] = A.LOWER[buf[~A.SEPARATORS[buf]]]
    symbol[upto[closing] - 1] = _END
    keys = np.ndarray(n, ">u8", laid, strides=(1,)).astype(np.uint64)
    keys &= np.uint64((1 << 8 * (ORDER + 1)) - 1)
    keys <<= np.uint64(3)
    keys |= np.uint64(ORDER)
    keys = keys.view(np.int64)
    # a text, or a word without what is before it, begins after a space
    last = upto[closing] if across else upto
    since = np.tile(np.arange(ORDER), len(last))
    young = np.repeat(np.insert(last[:-1], 0, 0), ORDER) + since
    held = young < np.repeat(last, ORDER)
    young, since = young[held], since[held]
    context = (keys[young] >> 11 & _LOWEST[since]) | np.int64(_SPACE) << 8 * since
    keys[young] = _key(context, since + 1, symbol[young].astype(np.int64))
    return keys, size


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    if not len(k):
        return k, c
    by = np.argsort(k)
    k = k[by]
    first = np.flatnonzero(_new(k))
    return k[first], np.add.reduceat(c[by], first)


def _new(v: np.ndarray) -> np.ndarray:
    """Which of sorted values are unlike the one before."""
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    return new


def _distinct(values: np.ndarray) -> np.ndarray:
    """As np.unique, by a sort: many times faster than by hashing for integers."""
    v = np.sort(values)
    return v[_new(v)]


def _met(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and how often each is there: by a sort of values alone, which is cheaper than one of places."""
    v = np.sort(values)
    first = np.flatnonzero(_new(v))
    return v[first], np.diff(first, append=len(v))


def shortened(keys: np.ndarray, counts: np.ndarray, orders) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of these grams' contexts of ``orders`` bytes, each found from those one byte longer; sorted within an order, the longest first."""
    order, parts = keys & 7, []
    for k in reversed(orders):
        own = order == k if parts else order >= k
        met = [*parts[-1:], (keys[own], counts[own])]
        parts.append(_summed([_key(g >> 11, k, g >> 3 & 255) for g, _ in met], [c for _, c in met]))
    return tuple(map(np.concatenate, zip(*parts)))


class Trie:
    """Code lengths from the counts of contexts, by array operations over many symbols at once.

    The bytes met in a context have all been met in the next shorter one, so what is excluded there is
    exactly what the longer one has met.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        by = np.argsort(keys)
        self.keys, c = keys[by], counts[by]
        order, entry = self.keys & 7, self.keys >> 3
        node = entry >> 8 << 3 | order
        by_node = np.argsort(node, kind="stable")
        self.nodes, first = np.unique(node[by_node], return_index=True)
        total = np.add.reduceat(c[by_node], first) if len(first) else np.zeros(0, np.int64)
        distinct = np.diff(np.append(first, len(c)))
        # what an entry's symbol counts in the next shorter context, for what that one excludes
        shorter = np.zeros(len(c), np.int64)
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(order == k)
            e = entry[at]
            ctx = e >> 8
            i = np.searchsorted(self.keys, _key(ctx, k - 1, e & 255))
            shorter[at] = c[np.minimum(i, len(c) - 1)]
        excluded = np.add.reduceat(shorter[by_node], first) if len(first) else shorter
        self.count, self.total, self.distinct, self.excluded = c, total, distinct, excluded

    def _find(self, sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of keys, or -1."""
        if not len(sorted_keys):
            return np.full(len(wanted), -1)
        i = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return np.where(sorted_keys[i] == wanted, i, -1)

    def log2(self, symbol: np.ndarray, context: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """log2 of each symbol's probability; ``depth``: how many bytes of context there are."""
        out = np.zeros(len(symbol))
        above = np.full(len(symbol), -1)  # the longer context that escaped
        left = np.arange(len(symbol))
        for k in range(ORDER, -1, -1):
            deep = left[depth[left] >= k]
            node = self._find(self.nodes, (context[deep] & ((1 << 8 * k) - 1)) << 3 | k)
            deep, node = deep[node >= 0], node[node >= 0]
            up = above[deep]
            had = up >= 0
            t = self.total[node] - np.where(had, self.excluded[up], 0)
            q = self.distinct[node] - np.where(had, self.distinct[up], 0)
            e = self._find(self.keys, _key(context[deep], k, symbol[deep]))
            met = (e >= 0) & (q > 0)
            out[deep[met]] += np.log2((2 * self.count[e[met]] - 1) / (2 * t[met]))
            gone = ~met & (q > 0)
            out[deep[gone]] += np.log2(q[gone] / (2 * t[gone]))
            above[deep] = node
            done = np.zeros(len(symbol), bool)
            done[deep[met]] = True
            left = left[~done[left]]
        met = np.zeros(len(left), np.int64)
        met[above[left] >= 0] = self.distinct[above[left][above[left] >= 0]]
        out[left] -= np.log2(_SYMBOLS - met)
        return out

    def price(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol in its context."""
        out, step = np.empty(len(keys)), 200_000
        for lo in range(0, len(keys), step):
            k = keys[lo : lo + step]
            out[lo : lo + step] = self.log2(k >> 3 & 255, k >> 11, k & 7)
        return out * math.log10(2)


def foretold(h: np.ndarray, row: np.ndarray, depth: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens the ``depth`` tokens before them foretell, and log10 of the share of each prediction (0 without one).

    A token that is foretold costs that share alone, any other one its price in the trie besides.
    ``h`` and ``row``: the tokens of texts laid end to end, each text's end included.
    """
    hit, share = np.zeros(len(h), bool), np.zeros(len(h))
    if len(h) <= depth:
        return hit, share
    g, at = A.ngrams(h, row, depth)
    at = at + depth
    inside = at < len(h)
    inside[inside] = row[at[inside]] == row[at[inside] - 1]
    g, at = g[inside], at[inside]
    its = row[at]
    by, same = _alike(g, its)
    before = np.full(len(at), -1)
    before[by[1:][same]] = at[by[:-1][same]]  # in order of places: the last time that these stood together
    made = before >= 0
    right = np.zeros(len(at), bool)
    right[made] = h[at[made]] == h[before[made]]
    begins = np.flatnonzero(_new(its))
    begin = np.repeat(begins, np.diff(begins, append=len(its)))
    so_far = [(total := np.cumsum(x) - x) - total[begin] for x in (made.astype(np.int64), right.astype(np.int64))]
    p = (so_far[1] + 0.5) / (so_far[0] + 1)
    hit[at[right]] = True
    share[at[right]] = np.log10(p[right])
    wrong = made & ~right
    share[at[wrong]] = np.log10(1 - p[wrong])
    return hit, share


def _alike(g: np.ndarray, row: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values of one row stand together, first ones first, and which of these are like the one before.

    Places are sorted as the lowest bits of mixed values; where what is left of these (of ``bits`` bits) takes different
    ones for one, the values themselves are sorted.
    """
    low = np.uint64((1 << len(g).bit_length()) - 1)
    rows = np.arange(row[0], row[-1] + 1) if len(row) else row  # rows come in order
    mixed = g ^ np.repeat(A.mix(rows.astype(np.uint64) + np.uint64(1)), np.bincount(row - row[0]) if len(row) else 0)
    if bits < 64:
        mixed &= ~np.uint64(0) << np.uint64(64 - bits)
    mixed &= ~low
    mixed |= np.arange(len(g), dtype=np.uint64)
    mixed.sort()
    by = (mixed & low).view(np.int64)
    like = lambda: (g[by][1:] == g[by][:-1]) & (row[by][1:] == row[by][:-1])
    same = like()
    if np.any((mixed[1:] | low == mixed[:-1] | low) & ~same):
        by = np.lexsort((g, row))
        same = like()
    return by, same


@dataclass
class Model:
    """Counts of all training words and grams, and of the contexts shorter than NEAR, in the shared folder.

    ``counts``: rows (kind, bucket, size, total, keys, counts), each with a sorted part of a bucket's keys; kind
    0 words, 1 grams, 2 short contexts; a bucket is the first ``bits`` bits of a hash.  Not ``spelled``: words only.
    """

    counts: DataFrame
    bits: int
    tokens: int
    distinct: int
    n_grams: int
    across: bool
    spelled: bool = True


COUNTED = "kind int, bucket int, size long, total long, keys binary, counts binary"


def _place(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each key: of words by their hash, of grams by the nearest NEAR bytes of their context, of short contexts the first."""
    small = np.uint16 if bits <= 16 else np.int64  # sorted by digits, not by comparisons
    if kind == 2:
        return np.zeros(len(keys), small)
    h = keys.view(np.uint64) if kind == 0 else A.mix((keys >> 11 & _LOWEST[NEAR]).astype(np.uint64) + np.uint64(1))
    return (h >> np.uint64(64 - bits)).astype(small)


def _packed(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Keys, sorted but for few places, and their counts as a row for each bucket."""
    bucket = _place(kind, keys, bits)
    by = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(_new(bucket[by]))
    full = bucket[by[at]]
    parts = np.split(by, at[1:]) if len(at) else []
    columns = [np.full(len(parts), kind, np.int32), full.astype(np.int32), np.array([len(x) for x in parts], np.int64), np.array([counts[x].sum() for x in parts], np.int64)]
    blobs = [[_squeezed(_steps(keys[x])) for x in parts], [_squeezed(counts[x]) for x in parts]]
    return pa.record_batch([*map(pa.array, columns), *(pa.array(x, pa.binary()) for x in blobs)], names=[x.split()[0] for x in COUNTED.split(", ")])


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys.view(np.uint64), prepend=np.uint64(0))


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_released(keys, np.uint64)).view(np.int64), _released(counts, np.int64)


def train(docs: DataFrame, across: bool = False, spelled: bool = True) -> Model:
    """Count words and contexts of all rows (column text; only where ``learn`` is true).

    ``across``: contexts go on over the words before, else each word begins anew.  Without ``spelled`` only words
    are counted, for base scores.  A task hands on sorted keys
    and counts by buckets; a bucket's parts are merged in one task.
    """
    prepare(docs.sparkSession)
    learnt = docs.where("learn").select(F.col("text").cast("string").alias("text"))
    size = learnt.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = min(24, _bits(size, BUCKET_BYTES))

    def count(batches):
        words: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        grams: tuple = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        new: dict = {"h": [], "k": []}
        texts = size = 0

        def merged():
            """What has been met since the last time, among what is held."""
            nonlocal words, grams, size
            words, grams = (_summed(*zip(old, *new[k])) for old, k in ((words, "h"), (grams, "k")))
            new.update(h=[], k=[])
            size = 0

        def flush():
            nonlocal words, grams, texts
            merged()
            if texts:
                h, n = _summed([words[0], np.array([END])], [words[1], np.array([texts])])
                k, c = grams
                low = shortened(k, c, range(NEAR))
                deep = k & 7 >= NEAR
                for kind, keys, counts in ((0, h.view(np.int64), n), (1, k[deep], c[deep]), (2, *low)):
                    yield _packed(kind, keys, counts, bits)
            words, grams, texts = (words[0][:0], words[1][:0]), (grams[0][:0], grams[1][:0]), 0

        for b in batches:
            for lo, hi, buf, off in A.chunks(b.column(0), PIECE):
                starts, ends, first = A.runs(buf, off)
                new["h"].append(_met(A.hashes(buf, starts, ends, folded=True)))
                new["k"].append(_met(coded(buf, starts, ends, first, across)[0]) if spelled else (grams[0][:0], grams[1][:0]))
                size += len(new["k"][-1][0]) or len(new["h"][-1][0])
                texts += hi - lo
                if size > FLUSH:
                    merged()
                    if max(len(grams[0]), 0 if spelled else len(words[0])) > FLUSH:
                        yield from flush()
        yield from flush()

    def merge(batches):
        place, keys, counts = None, [], []

        def done():
            k, c = _summed([x.view(np.uint64) for x in keys], counts)
            return pa.record_batch([[place[1]], [place[0]], [len(k)], [int(c.sum())], [_squeezed(_steps(k))], [_squeezed(c)]], schema=schema)

        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("size", pa.int64()), ("total", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        for b in batches:
            for kind, bucket, k, c in zip(*(b.column(i).to_pylist() for i in (0, 1, 4, 5))):
                if (bucket, kind) != place:
                    if place:
                        yield done()
                    place, keys, counts = (bucket, kind), [], []
                k, c = _unpacked(k, c)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > FLUSH and len(keys) > 8:  # what is held stays near what is different
                    k, c = _summed([x.view(np.uint64) for x in keys], counts)
                    keys, counts = [k.view(np.int64)], [c]
        if place:
            yield done()

    parts = learnt.mapInArrow(count, COUNTED)
    counted = written(parts.repartition("bucket", "kind").sortWithinPartitions("bucket", "kind").mapInArrow(merge, COUNTED), "counts")
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(F.sum("size").alias("size"), F.sum("total").alias("total")).collect()}
    of = lambda kind, name: sums[kind][name] if kind in sums else 0
    return Model(counted, bits, of(0, "total"), of(0, "size"), of(1, "size"), across, spelled)


def _bits(n: int, each: int) -> int:
    return max(4, math.ceil(math.log2(max(1, n / each))))


class _Chunk:
    """Texts laid end to end: what they ask, and sums of what is answered.  ``asks``: nothing will be answered."""

    def __init__(self, texts: pa.Array, across: bool, spelled: bool = True, asks: bool = False):
        self.docs = len(texts)
        self.tokens, self.own = np.zeros(self.docs, np.int64), np.zeros(self.docs)
        #: Runs of the different values of words and of grams, sorted; how often each is there, and the rows of these.
        self.values, self.places = ([], []), ([], [])
        for lo, hi, buf, off in A.chunks(texts, PIECE):
            starts, ends, first = A.runs(buf, off)
            h = np.insert(A.hashes(buf, starts, ends, folded=True), first[1:], END)
            row = np.insert(A.rows_of(first), first[1:], np.arange(hi - lo))
            self.tokens[lo:hi] = np.diff(first) + 1
            kept = (row + lo).astype(np.uint16 if self.docs < 1 << 16 else np.int32)
            self._keep(0, h, kept, asks)
            if spelled:
                hit, share = foretold(h, row)
                self.own[lo:hi] = np.bincount(row, share, hi - lo)
                k, size = coded(buf, starts, ends, first, across)
                priced = ~hit
                self._keep(1, k.view(np.uint64)[np.repeat(priced, size)], np.repeat(kept[priced], size[priced]), asks)

    def _keep(self, kind: int, values: np.ndarray, rows: np.ndarray, asks: bool):
        if asks:
            self.values[kind].append(_distinct(values))
            return
        by = np.argsort(values)
        v = values[by]
        first = np.flatnonzero(_new(v))
        self.values[kind].append(v[first])
        self.places[kind].append((np.diff(first, append=len(v)).astype(np.int32), rows[by]))

    def _different(self, kind: int) -> np.ndarray:
        return _distinct(np.concatenate([np.zeros(0, np.uint64), *self.values[kind]]))

    def asked(self, kind: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The different values by bucket, sorted within each, and the buckets' edges."""
        different = self._different(kind).view(np.int64)
        bucket = _place(kind, different, bits)
        by = np.argsort(bucket, kind="stable")
        return different[by], np.insert(np.cumsum(np.bincount(bucket, minlength=1 << bits)), 0, 0)

    def answered(self, kind: int, bits: int, answers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The answers for different values, given those in the order of ``asked``; how often each is there, and the rows of these; in runs."""
        different = self._different(kind)
        of = np.empty(len(different))
        of[np.argsort(_place(kind, different.view(np.int64), bits), kind="stable")] = answers
        for values, (n, rows) in zip(self.values[kind], self.places[kind]):
            yield of[np.searchsorted(different, values)], n, rows


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row (doc_id, text).

    Texts are asked about by chunks: a chunk's different words and grams go to their buckets, counts and prices
    come back to the chunk's texts, which travel as one compressed row, and are summed there.  ``score`` is null
    where the model counts words only.
    """
    spark = prepare(docs.sparkSession)
    across, spelled = model.across, model.spelled
    word_bits, gram_bits = (min(model.bits, _bits(n, each)) for n, each in ((model.distinct, BUCKET_WORDS), (model.n_grams, BUCKET_GRAMS)))
    n_words, n_grams = 1 << word_bits, 1 << gram_bits if spelled else 0
    # buckets of words come first, those of grams behind them

    def gather(batches):
        """Texts as rows of chunks, compressed."""
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for ids, texts in _gathered(batches):
            head = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(head)
            yield pa.record_batch([pa.array([part << 24 | nth]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "texts"])
            nth += 1

    def opened(texts: bytes, asks: bool = False) -> tuple[pa.Array, _Chunk]:
        with pa.ipc.open_stream(texts) as stream:
            head = stream.read_next_batch()
        return head.column(0), _Chunk(head.column(1), across, spelled, asks)

    def ask(batches):
        for b in batches:
            for number, texts in zip(b.column(0).to_pylist(), b.column(1)):
                _, chunk = opened(texts.as_py(), asks=True)
                for kind, bits, base in ((0, word_bits, 0), (1, gram_bits, n_words))[: 1 + spelled]:
                    values, edges = chunk.asked(kind, bits)
                    full = np.flatnonzero(np.diff(edges))
                    blobs = [_squeezed(_steps(values[edges[k] : edges[k + 1]])) for k in full]
                    yield pa.record_batch([pa.array((full + base).astype(np.int32)), pa.array([number] * len(full), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "asked"])

    def answer(batches):
        place, held, ready = None, [], None
        for b in batches:
            out: list[tuple] = []
            rows = zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("bucket", "salt", "chunk", "asked", "keys", "counts")))
            for bucket, salt, chunk, asked, keys, counts in rows:
                if (bucket, salt) != place:
                    place, held, ready = (bucket, salt), [], None
                if asked is None:  # counts come before questions
                    held.append(_unpacked(keys, counts))
                    continue
                if ready is None:
                    k, c = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
                    held, ready = [], _gram_prices(k, c) if bucket >= n_words else _word_counts(k, c)
                out.append((bucket, chunk, _told(ready(np.cumsum(_released(asked, np.uint64)).view(np.int64)))))
                if len(out) == 64:
                    yield _columns(out)
                    out = []
            if out:
                yield _columns(out)

    def _columns(out):
        bucket, chunk, told = zip(*out)
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(told, pa.binary())], names=["bucket", "chunk", "told"])

    floor = math.log10(model.tokens + 0.5 * (model.distinct + 1))

    def total(batches):
        number, held, told = None, None, []

        def rows():
            ids, chunk = opened(held)
            heard = lambda mine: np.concatenate([_heard(x) for x in mine]) if mine else np.zeros(0)
            known, base, own = np.zeros(chunk.docs, np.int64), -floor * chunk.tokens, chunk.own
            for counts, n, row in chunk.answered(0, word_bits, heard([x for k, x in told if k < n_words])):
                known += np.bincount(row, np.repeat(counts > 0, n), chunk.docs).astype(np.int64)
                base = base + np.bincount(row, np.repeat(np.log10(counts + 0.5), n), chunk.docs)
            for prices, n, row in chunk.answered(1, gram_bits, heard([x for k, x in told if k >= n_words])) if spelled else ():
                own = own - np.bincount(row, np.repeat(prices / _UNIT, n), chunk.docs)
            return pa.record_batch([ids, pa.array(chunk.tokens), pa.array(known), pa.array(base), pa.array(own) if spelled else pa.nulls(chunk.docs, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for bucket, chunk, texts, x in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("bucket", "chunk", "texts", "told"))):
                if chunk != number:
                    if number is not None:
                        yield rows()
                    number, told = chunk, []
                if bucket < 0:
                    held = texts
                else:
                    told.append((bucket, x))
        if number is not None:
            yield rows()

    rows_in = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    # what a chunk is, is settled once, however often its row is read
    heads = written(rows_in.mapInArrow(gather, "chunk long, texts binary"), "chunks")
    questions = heads.mapInArrow(ask, "bucket int, chunk long, asked binary")
    volume = heads.agg(F.coalesce(F.sum(F.length("texts")), F.lit(0)).alias("n")).first()["n"]
    # a bucket's chunks are dealt to several tasks, each with a copy of its counts, where they are much
    copies = max(1, math.ceil(volume / (n_words + n_grams) / TASK_BYTES))
    questions = questions.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(copies)).cast("int"))
    counts = model.counts.select("kind", "bucket", "keys", "counts")
    nearer = lambda bits: F.shiftright("bucket", model.bits - bits)
    every = F.explode(F.sequence(F.lit(n_words), F.lit(n_words + n_grams - 1)))
    kinds = [counts.where("kind = 0").withColumn("bucket", nearer(word_bits)), counts.where("kind = 1").withColumn("bucket", nearer(gram_bits) + n_words), counts.where("kind = 2").withColumn("bucket", every)]
    known = (kinds[0].unionByName(kinds[1]).unionByName(kinds[2]) if spelled else kinds[0]).drop("kind").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    both = questions.unionByName(known, allowMissingColumns=True)
    met = both.repartitionById(copies * (n_words + n_grams), F.col("bucket") * copies + F.col("salt")).sortWithinPartitions("bucket", "salt", F.col("chunk").asc_nulls_first())
    answered = met.mapInArrow(answer, "bucket int, chunk long, told binary")
    back = heads.withColumn("bucket", F.lit(-1)).unionByName(answered, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    return back.mapInArrow(total, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def _gathered(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of runs of about CHUNK bytes of text, null texts as empty ones."""
    ids, texts, size = [], [], 0
    for b in batches:
        for lo, hi, buf, _ in A.chunks(b.column(1), CHUNK):
            ids.append(b.column(0).slice(lo, hi - lo))
            texts.append(b.column(1).slice(lo, hi - lo).fill_null("").cast(pa.large_string()))
            size += len(buf)
            if size >= CHUNK:
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


#: Prices travel as whole numbers of this part of a decimal digit.
_UNIT = 1 << 25


def _told(values: np.ndarray) -> bytes:
    """Answers in the order of the questions: counts, or prices in units."""
    return _squeezed(values.astype(np.uint64) if values.dtype.kind == "i" else np.rint(-values * _UNIT).astype(np.uint64))


def _heard(data: bytes) -> np.ndarray:
    return _released(data, np.uint64).astype(float)


def _squeezed(a: np.ndarray) -> bytes:
    """An array as compressed planes of bytes: most high bytes are zero."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return len(a).to_bytes(4, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(a) else b"")


def _released(data: bytes, kind) -> np.ndarray:
    n, kind = int.from_bytes(data[:4], "little"), np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[4:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def _word_counts(h: np.ndarray, c: np.ndarray):
    by = np.argsort(h)
    h, c = h[by], c[by]

    def counts(want: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(len(want), np.int64)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        return np.where(h[at] == want, c[at], 0)

    return counts


def _gram_prices(k: np.ndarray, c: np.ndarray):
    """Prices of grams from a bucket's grams and the short contexts of all; those of its own grams are found once."""
    deep = k & 7 >= NEAR
    short, grams, n = (k[~deep], c[~deep]), k[deep], c[deep]
    parts = [short] if not len(grams) else [short, shortened(grams, n, range(NEAR, ORDER + 1))]
    trie = Trie(*map(np.concatenate, zip(*parts)))
    known = np.sort(grams)
    cost = trie.price(known)

    def prices(want: np.ndarray) -> np.ndarray:
        out, new = np.empty(len(want)), np.ones(len(want), bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, want), len(known) - 1)
            new = known[at] != want
            out[~new] = cost[at[~new]]
        out[new] = trie.price(want[new])
        return out

    return prices


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str, spelled: bool = True) -> DataFrame:
    """The columns of ``op4_ppm``; without ``spelled`` those that counts of words decide, and no score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False))
    model = train(docs.withColumn("learn", ~held_out), across=True, spelled=spelled)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
