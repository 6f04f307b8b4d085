"""Document fingerprints (SimHash) and the search within a Hamming radius, with DataFrame functions only.

Terms are the five-word shingles of a text (all its words, if there are fewer than five), each weighted by
how often it occurs.  Every occurrence votes on the 64 bits of its hash; a bit of the fingerprint is 1 if
more than half of the votes say so.  Fingerprints are 16 hex digits.  The likeness of two is 1 at distance
0 and falls as the cosine that the distance stands for: max(0, cos(pi d / 64)).

Null is the empty text; a text without words has the fingerprint of zeros.  Equal texts have equal
fingerprints.  Repeated rows are kept; rows with the same id are ordered by the hash of their text, null ids
come last.  Extra columns of the input are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHINGLE = 5
#: Keys of a range that are put in order in one task, about.
RANGE_ROWS = 500_000
#: Bits that may differ between fingerprints that the query finds near each other.
RADIUS = 3


def terms(text: Column) -> Column:
    """Hashes of the shingles of a text, one for each occurrence."""

    def shingles(words: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))

    return let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), shingles)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def simhash(terms_df: DataFrame, keys: list[str], hashes: str = "terms") -> DataFrame:
    """(keys, fingerprint) for rows (keys, an array of hashes): one fingerprint (long) for each set of keys, 0 without hashes.

    Votes are sums of 16-bit lanes, four in a long, over runs of 32,767 hashes at most, so no lane overflows
    however long a text is; they are summed up where the texts are, and a row a run is shuffled.
    """
    votes = terms_df.select(*keys, F.posexplode_outer(hashes).alias("place", "h"))
    lanes = [F.expr(f"sum(shiftrightunsigned(h, {i}) & {0x0001000100010001}L)").alias(f"s{i}") for i in range(16)]
    runs = votes.groupBy(*keys, F.expr("coalesce(place, 0) div 32767").alias("run")).agg(F.count("h").alias("n"), *lanes)
    ones = [F.expr(f"sum(shiftrightunsigned(s{b % 16}, {b - b % 16}) & 65535L)").alias(f"b{b}") for b in range(64)]
    sums = runs.groupBy(*keys).agg(F.sum("n").alias("n"), *ones)
    bits = " | ".join(f"if(2 * b{b} > n, shiftleft(1L, {b}), 0L)" for b in range(64))
    return sums.select(*keys, F.expr(bits).alias("fingerprint"))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    d = distance(a, b)
    return F.when(d == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(d * F.lit(3.141592653589793 / 64))))


def _permuted_keys(fingerprint: Column, radius: int, blocks: int) -> Column:
    """A key for each choice of blocks - radius of the blocks: two fingerprints within the radius share one at least."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = 0
        for i in chosen:
            mask |= masks[i]
        keys.append(F.struct(F.lit(t).alias("t"), fingerprint.bitwiseAND(F.lit(signed(mask))).alias("k")))
    return F.array(*keys)


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Distinct pairs (query, found, distance) of different fingerprints within ``radius``; columns named fingerprint.

    Each table holds the fingerprints under some of their blocks: all choices of blocks - radius blocks, so
    no pair is missed.  Equal fingerprints are one row of a table however many documents have them.  More
    blocks give longer keys and more tables, for more rows.
    """
    left = queries.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct().select(F.col("fingerprint").alias("query"), F.explode(_permuted_keys(F.col("fingerprint"), radius, blocks)).alias("key"))
    right = fingerprints.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct().select(F.col("fingerprint").alias("found"), F.explode(_permuted_keys(F.col("fingerprint"), radius, blocks)).alias("key"))
    pairs = left.join(right, "key").where("query != found").select("query", "found", distance(F.col("query"), F.col("found")).alias("distance"))
    return pairs.where(F.col("distance") <= radius).distinct()


#: Names of a node's key: its id (0 for none), whether it has none, and the hash of its text.
_KEY = ["ki", "kz", "kh"]


def _nodes(docs: DataFrame) -> DataFrame:
    """Rows (ki, kz, kh, text): a key and its text for every row; rows equal in id and text have one key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select(F.coalesce("id", F.lit(0).cast("long")).alias("ki"), F.col("id").isNull().alias("kz"), F.xxhash64("text").alias("kh"), "text")


def following(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(ki, kz, kh, copies, n_chars, ni, nz, nh): every distinct key with the next one in descending order of doc_id.

    Null ids come last, equal ids go by the hash of their text, and the first key follows the last.  Only keys
    and lengths travel: they are dealt into ranges of about ``range_rows`` keys, each written in order, and the
    last key of a range meets the first of the next one through a table of a row a range.
    """
    keys = _nodes(docs).groupBy(*_KEY).agg(F.count("*").alias("copies"), F.max(F.length("text")).cast("long").alias("n_chars"))
    keys = written(keys, "keys")
    ranges = max(1, math.ceil(keys.count() / range_rows))
    order = [F.col("kz"), F.col("ki").desc(), F.col("kh")]
    placed = written(keys.repartitionByRange(ranges, *order).withColumn("at", F.spark_partition_id()), "placed")
    key = F.struct(*_KEY)
    heads = placed.groupBy("at").agg(F.min_by(key, F.struct("kz", -F.col("ki").cast("decimal(20,0)"), "kh")).alias("head"))
    # a row a range: one task puts these few in order
    heads = heads.select("at", F.lead("head").over(Window.orderBy("at")).alias("next_head"), F.min_by("head", "at").over(Window.partitionBy()).alias("first"))
    inside = placed.withColumn("next", F.lead(key).over(Window.partitionBy("at").orderBy(*order)))
    joined = inside.join(heads, "at").withColumn("next", F.coalesce("next", "next_head", "first"))
    return joined.select(*_KEY, "copies", "n_chars", F.col("next.ki").alias("ni"), F.col("next.kz").alias("nz"), F.col("next.kh").alias("nh"))


def fingerprint_documents(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The fingerprint of every text, of its edited text, and their likeness (see the module's head).

    The edited text: the last third of the code points replaced by as many of the next text's first.  Texts
    are shuffled once by their keys; from there only the beginnings that other texts need go on to those.
    Of rows equal in id and text each but the last is followed by another of them.
    """
    order = written(following(docs, range_rows), "following")
    texts = _nodes(docs).groupBy(*_KEY).agg(F.first("text").alias("text"))  # copies become one before the shuffle
    needs = order.select(F.col("ni").alias("ki"), F.col("nz").alias("kz"), F.col("nh").alias("kh"), F.expr("n_chars div 3").cast("int").alias("size"), F.struct(*_KEY).alias("by"))
    heads = texts.join(needs, _KEY).select("by.*", F.expr("substring(text, 1, size)").alias("head"))
    both = texts.join(heads, _KEY)
    third = "cast(length(text) div 3 as int)"
    joint = lambda head: F.expr(f"concat(substring(text, 1, length(text) - {third}), {head})")
    sides = [F.struct(F.lit(k).alias("side"), t.alias("t")) for k, t in ((0, F.col("text")), (1, joint("head")), (2, joint(f"substring(text, 1, {third})")))]
    side = F.explode(F.array(*sides)).alias("s")
    # side 2, for a row that is followed by its own copy, is needed by few
    copied = both.join(order.select(*_KEY, "copies"), _KEY).select(*_KEY, side, "copies").where("s.side < 2 or copies > 1")
    each = copied.select(*_KEY, F.col("s.side").alias("side"), F.when(F.col("s.side") > 0, F.sha2(F.col("s.t").cast("binary"), 256)).alias("sha"), terms(F.col("s.t")).alias("terms"))
    printed = simhash(each, [*_KEY, "side", "sha"])
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    prints = written(printed.groupBy(*_KEY).agg(of(0, "fingerprint").alias("own"), *(of(k, x).alias(f"{x}{k}") for k in (1, 2) for x in ("fingerprint", "sha"))), "prints")
    led = order.join(prints, _KEY).join(prints.select(F.col("ki").alias("ni"), F.col("kz").alias("nz"), F.col("kh").alias("nh"), F.col("own").alias("led")), ["ni", "nz", "nh"])
    rows = led.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    last = F.col("nth") == F.col("copies")
    changed = F.when(last, F.col("fingerprint1")).otherwise(F.col("fingerprint2"))
    return rows.select(
        F.when(~F.col("kz"), F.col("ki")).alias("doc_id"), "n_chars",
        F.when(last, F.col("sha1")).otherwise(F.col("sha2")).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        likeness(F.col("own"), changed).alias("near_edited"),
        F.when(last, likeness(F.col("own"), F.col("led"))).otherwise(1.0).alias("near_next"),
        F.col("own").alias("print"),
    )


def neighbours(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, n_near): how many other rows have a fingerprint within ``radius``, for the prints of rows whose doc_id is divisible by 100.

    ``prints``: rows (doc_id, print).  The search is by permuted tables over all distinct fingerprints.
    """
    distinct = written(prints.groupBy("print").agg(F.count("*").alias("rows"), F.max(F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))).alias("asked")), "distinct")
    asked = distinct.where("asked").select("print", "rows")
    pairs = within_radius(asked.select(F.col("print").alias("fingerprint")), distinct.select(F.col("print").alias("fingerprint")), radius)
    found = pairs.join(distinct.select(F.col("print").alias("found"), "rows"), "found").groupBy(F.col("query").alias("print")).agg(F.sum("rows").alias("others"))
    return asked.join(found, "print", "left").select("print", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every row; ``n_near``, for rows whose doc_id is divisible by 100, by the search over all rows."""
    rows = written(fingerprint_documents(table(spark, sf_dir, "documents")), "fingerprints")
    near = neighbours(rows.select("doc_id", "print"))
    asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    # only the rows that ask meet their answers: all rows of one print would be one task's
    answered = rows.where(asked).join(near, "print", "left").drop("print")
    return answered.unionByName(rows.where(~asked).drop("print").withColumn("n_near", F.lit(None).cast("long")))
