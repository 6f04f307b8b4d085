"""N-gram Jaccard self-join: MinHash banding finds candidates, full n-gram sets verify them.

Words are runs of bytes other than space and 0x09-0x0D, as they are.  A text's n-grams are its distinct runs
of five words (all its words, if there are fewer).  Two texts are linked if the Jaccard similarity of these
sets is at least THRESHOLD.  Bands and rows are chosen so that a pair just at the threshold shares a band
with probability RECALL; pairs that share one are all verified, with no cap on the size of a bucket.

Equal texts are one node, so copies are never paired with each other.  A bucket's members with their sets
meet in one task, or in a task for each pair of blocks if there are many; the task verifies all pairs with
array operations and gives a count for each member and a spanning forest of the links, never the pairs.
A pair counts in the first band that both share.

Null is the empty text.  Texts without words have no n-grams and no links: their class is that of their
copies.  Rows with equal ids, and null ids, are rows of their own.  A class is named by its least doc_id
(null if all are null).  Extra columns of the input are not read.  Nodes are 64-bit hashes of the text:
of n different texts, about n^2 / 2^65 pairs are expected to be taken for copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text_arrays as A
from .common import prepare, table, written

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99
#: Rows of a signature at most; members and n-grams of a block, about.
ROWS, BLOCK, BLOCK_GRAMS = 160, 256, 1 << 19
#: n-grams that more members than this share are counted by a matrix product.
HEAVY = 48


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = ROWS) -> tuple[int, int]:
    """(bands, rows of each): the most rows, and so the fewest false candidates, that reach ``recall`` within ``most``."""
    for rows in range(20, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def gram_sets(col: pa.Array, n: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct n-gram hashes ordered by row and hash, each row's first)."""
    for lo, hi, buf, off in A.chunks(col):
        starts, ends, first = A.runs(buf, off)
        h, row = A.hashes(buf, starts, ends), A.rows_of(first)
        g, at = A.ngrams(h, row, n)
        g, r = [g], [row[at]]
        count = np.diff(first)
        for size in range(1, n):  # texts of fewer words: all of them, as one n-gram
            short = np.flatnonzero(count == size)
            if len(short):
                total = h[first[short]].copy()
                for k in range(1, size):
                    total = A.mix(total + np.uint64(size)) ^ h[first[short] + k]
                g.append(A.mix(total + np.uint64(1000 + size)))
                r.append(short)
        g, r = np.concatenate(g), np.concatenate(r)
        by = np.lexsort((g, r))
        g, r = g[by], r[by]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[new], r[new]
        yield lo, hi, g, np.searchsorted(r, np.arange(hi - lo + 1))


def band_hashes(g: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each set (all must be non-empty); the lowest byte is the band's number."""
    rng = np.random.Generator(np.random.PCG64(97))
    mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.empty((bands * rows, len(first) - 1), np.uint64)
    for k, m in enumerate(mul):
        low[k] = np.minimum.reduceat((g * m) ^ (m >> np.uint64(17)), first[:-1])
    out = np.zeros((len(first) - 1, bands), np.uint64)
    for b in range(bands):
        for k in range(b * rows, (b + 1) * rows):
            out[:, b] = A.mix(out[:, b] + low[k])
        out[:, b] = out[:, b] & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(b)
    return out


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for lo, hi, g, first in gram_sets(b.column(1), n):
                full = np.flatnonzero(np.diff(first) > 0)
                if not len(full):
                    continue
                edges = np.append(first[full], len(g))
                h = band_hashes(g, edges, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(h.ravel()))
                yield pa.record_batch([b.column(0).take(pa.array(full + lo)), pa.array(np.diff(edges)), lists], names=["node", "grams", "bands"])

    return docs.select("node", "text").mapInArrow(run, "node long, grams long, bands array<long>")


def common_counts(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sizes of all intersections of sets laid end to end: light n-grams by counting pairs, heavy ones by products."""
    m = len(first) - 1
    member = np.repeat(np.arange(m), np.diff(first))
    by = np.argsort(grams, kind="stable")
    g, who = grams[by], member[by]
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(g)))
    out = np.zeros((m, m), np.float32)
    heavy = np.flatnonzero(size > HEAVY)
    for lo in range(0, len(heavy), 2048):
        part = heavy[lo : lo + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for k, i in enumerate(part):
            x[who[cut[i] : cut[i] + size[i]], k] = 1
        out += x @ x.T
    for s in np.unique(size[(size > 1) & (size <= HEAVY)]):
        at = cut[size == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, (1 << 21) // len(i))
        for lo in range(0, len(at), step):
            rows = who[at[lo : lo + step, None] + np.arange(s)]
            pairs = (rows[:, i] * m + rows[:, j]).ravel()
            if len(pairs) * 4 < m * m:
                u, c = np.unique(pairs, return_counts=True)
                out.ravel()[u] += c
            else:
                out += np.bincount(pairs, minlength=m * m).reshape(m, m)
    return np.maximum(out, out.T)


def links_of(grams: list[np.ndarray], bands: np.ndarray, band: int, side: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member that count in this bucket, and a spanning forest of them as (member, member).

    ``side``: in a task for two blocks, the block of each member (only pairs across count); in any other -1.
    """
    size = np.array([len(g) for g in grams])
    first = np.append(0, np.cumsum(size))
    common = common_counts(np.concatenate(grams), first)
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    for b in range(band):  # pairs that share an earlier band count there
        linked &= bands[:, b][:, None] != bands[:, b][None, :]
    if side[0] >= 0:
        linked &= side[:, None] != side[None, :]
    counts, forest = linked.sum(1), []
    left = counts > 0
    while left.any():
        queue = [int(np.flatnonzero(left)[0])]
        left[queue[0]] = False
        while queue:
            a = queue.pop()
            new = np.flatnonzero(linked[a] & left)
            left[new] = False
            forest += [(a, int(b)) for b in new]
            queue += new.tolist()
    return counts, forest


def _verified(texts: DataFrame, n: int, threshold: float, per_task: int) -> DataFrame:
    """(node, other, links) from rows (node, text, bands, places); places: (bucket, band, blocks) of each bucket."""

    def spread(batches):
        for b in batches:
            places = b.column(3).to_pylist()
            for lo, hi, g, first in gram_sets(b.column(1), n):
                which, bucket, pair, side, band = [], [], [], [], []
                for k in range(lo, hi):
                    node = b.column(0)[k].as_py()
                    for p in places[k]:
                        own = (node ^ node >> 29) % p["blocks"]
                        for other in range(p["blocks"]):
                            which.append(k - lo)
                            bucket.append(p["bucket"])
                            pair.append(min(own, other) * p["blocks"] + max(own, other))
                            side.append(-1 if own == other else own)
                            band.append(p["band"])
                step = max(1, (1 << 20) // max(1, int(np.diff(first).max())))  # a giant text is copied one row at a time
                for s in range(0, len(which), step):
                    w = np.array(which[s : s + step])
                    sets = [g[first[i] : first[i + 1]] for i in w]
                    ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)
                    grams = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                    take = pa.array(w + lo)
                    yield pa.record_batch([pa.array(bucket[s : s + step], pa.int64()), pa.array(pair[s : s + step], pa.int64()), pa.array(side[s : s + step], pa.int32()), pa.array(band[s : s + step], pa.int32()), b.column(0).take(take), b.column(2).take(take), grams.cast(pa.list_(pa.int64()))], names=["bucket", "pair", "side", "band", "node", "bands", "grams"])

    def verify(batches):
        key, members = None, {}

        def done():
            if len(members) < 2:
                return
            nodes = list(members)
            rows = list(members.values())
            counts, forest = links_of([r[2] for r in rows], np.stack([r[1] for r in rows]), rows[0][3], np.array([r[0] for r in rows]), threshold)
            for k in np.flatnonzero(counts):
                out.append((nodes[k], None, int(counts[k])))
            for a, b in forest:
                out.append((nodes[a], nodes[b], 0))

        def batch():
            a, o, c = zip(*out)
            out.clear()
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(o, pa.int64()), pa.array(c, pa.int64())], names=["node", "other", "links"])

        out: list = []
        for b in batches:
            grams, offsets = b.column(6).values.to_numpy(zero_copy_only=False).view(np.uint64), b.column(6).offsets.to_numpy()
            each, at = b.column(5).values.to_numpy(zero_copy_only=False), b.column(5).offsets.to_numpy()
            for k, row in enumerate(zip(*(b.column(i).to_pylist() for i in range(5)))):
                if row[:2] != key:
                    done()
                    key, members = row[:2], {}
                members[row[4]] = (row[2], each[at[k] : at[k + 1]].copy(), grams[offsets[k] : offsets[k + 1]].copy(), row[3])
            if len(out) > 10_000:
                yield batch()
        done()
        if out:
            yield batch()

    spread_out = texts.select("node", "text", "bands", "places").mapInArrow(spread, "bucket long, pair long, side int, band int, node long, bands array<long>, grams array<long>")
    met = spread_out.repartition(per_task, "bucket", "pair").sortWithinPartitions("bucket", "pair", "node")
    return met.mapInArrow(verify, "node long, other long, links long")


def _possible(keyed: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose node may be among the members: a Bloom filter of one bit a node, 32 MB at most."""
    bits = min(28, max(12, math.ceil(math.log2(16 * max(1, members.count())))))
    place = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << bits))
    words = members.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(node, 5), {1 << bits}) & 63 as int))")).alias("b"))
    found = words.toArrow()
    field = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    field[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    shared = keyed.sparkSession.sparkContext.broadcast(field)

    def keep(batches):
        for b in batches:
            at = b.column(2).to_numpy()
            hit = shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            yield b.filter(pa.array(hit.astype(bool))).select(["node", "text"])

    return keyed.select("node", "text", place.alias("place")).mapInArrow(keep, "node long, text string")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b).

    Each round takes the least label next to a node, then the label of that label; every round is written,
    so a lost executor costs one round at most.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("further"))
        following = written(lower.join(jump, "new", "left").select("node", "old", F.least("new", "further").alias("label")), "labels")
        changed = following.where("old != label").limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, first_copy, text_key, class_key) for every row.

    class_id: the least doc_id of all rows whose texts are connected by links; n_links: how many other
    different texts the row's text is linked to; n_copies: rows with this very text; first_copy: their least id.  class_key: equal
    within a class, whatever its ids; text_key: xxhash64 of the text.
    """
    spark = prepare(docs.sparkSession)
    bands, rows = bands_and_rows(threshold, recall)
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows_in.withColumn("node", F.xxhash64("text"))
    nodes = written(keyed.groupBy("node").agg(F.min("doc_id").alias("first_copy"), F.count("*").alias("n_copies")), "nodes")
    signed = written(_signatures(keyed, n, bands, rows).dropDuplicates(["node"]), "signatures")
    hashes = signed.select("node", "grams", F.explode("bands").alias("h"))
    buckets = hashes.groupBy("h").agg(F.count("*").alias("m"), F.sum("grams").alias("grams"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    # buckets with the same members count once, in their first band; a bucket is named by its members
    band = F.col("h").bitwiseAND(F.lit(255))
    kept = buckets.groupBy("m", "x").agg(F.min(F.struct(band.alias("band"), "h")).alias("f"), F.max("grams").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    kept = kept.select(F.col("f.band").cast("int").alias("band"), F.col("f.h").alias("h"), F.xxhash64("m", "x").alias("bucket"), F.least(blocks, F.col("m").cast("int")).alias("blocks"))
    places = hashes.select("node", "h").join(kept, "h").groupBy("node").agg(F.collect_list(F.struct("bucket", "band", "blocks")).alias("places"))
    members = written(signed.select("node", "bands").join(places, "node"), "members")
    one = _possible(keyed, members).groupBy("node").agg(F.first("text").alias("text"))  # copies are one row before they are shuffled
    texts = members.join(one, "node")
    per_task = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(_verified(texts, n, threshold, per_task), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classed = nodes.join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classed.groupBy("label").agg(F.min("first_copy").alias("class_id"))
    classed = classed.join(least, "label").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "first_copy", "label")
    return keyed.select("doc_id", "node").join(classed, "node").select("doc_id", "class_id", "n_links", "n_copies", "first_copy", F.col("node").alias("text_key"), F.col("label").alias("class_key"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
