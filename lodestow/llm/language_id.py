"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: naive Bayes over hashed runs of three bytes and whole words.  The models are fitted on a sample of at
  most about SAMPLE rows for each declared language; neighbouring grams depend on each other, so the mean
  log-likelihood of a gram counts for no more than WEIGHT grams.
* Declared markup language (an attribute of the page, a column of the row): how often each is declared for
  texts of each language, counted over all rows by their text posteriors.
* Address suffix and host: priors by grouped sums of the text posteriors over all rows, a host's smoothed
  towards its suffix's, the suffix's towards the corpus's; a row's own share is taken out of its host's.

The answer is the language of the greatest posterior.  A row is accepted if that posterior reaches ACCEPT and
its text is more likely under that language than under evenly spread grams.  Every declared language with at
least LEAST rows has a text model.  A row that declares a language without one, and that is accepted for no
other, is taken at its word: its answer is that language, of probability 0, and it is accepted.  Null, empty and blank texts have
no evidence of their own: the answer comes from the priors and they are not accepted.  Unknown or missing
declarations, suffixes and hosts add nothing.  Repeated rows are rows of their own.  An empty table gives an
empty result.  Extra columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from . import text_arrays as A
from .common import prepare, table, written

BITS, SAMPLE = 16, 1500
#: Declared rows that a language's text model needs at least.
LEAST = 20
WEIGHT, PRIOR_ROWS, ACCEPT = 60.0, 20.0, 0.5
#: Bytes of sums by declaration, suffix or host, counted before, that are broadcast at most.
SMALL = 16 << 20


#: The value of a byte in the hash of three, with A-Z as a-z.
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]


@dataclass
class TextModel:
    languages: list[str]
    #: log P(gram | language), and a last row for evenly spread grams.
    log: np.ndarray


def primary(tag: Column) -> Column:
    """The primary language of a tag such as en-GB; null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def visible(html: Column) -> Column:
    """The text of a page, roughly: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>", " ")
    return F.regexp_replace(bare, r"&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);", " ")


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    host = F.nullif(F.lower(F.regexp_extract(F.col("url"), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), visible(F.col("html")).alias("text"), F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", 1).alias("tag"), host.alias("host"))
    return rows.select("id", "text", primary(F.col("tag")).alias("declared"), F.nullif(F.substring_index("host", ".", -1), F.lit("")).alias("suffix"), "host")


def evidence_of_documents(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Documents have no address: their source stands for the host.  ``whole``: with each row itself as ``row``."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), primary(F.col("lang")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), *row)


def _grams(buf, off) -> tuple[np.ndarray, np.ndarray]:
    """Gram indices of these rows, and the rows'."""
    low = _VALUES[buf]
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    three, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(buf) > 2:
        inside = (rows[:-2] == rows[2:]) & ~(A.SEPARATORS[buf[:-2]] & A.SEPARATORS[buf[1:-1]] & A.SEPARATORS[buf[2:]])
        three, row = A.mix(low[:-2] + low[1:-1] * np.uint64(3) + low[2:] * np.uint64(5))[inside], rows[:-2][inside]
    starts, ends, first = A.runs(buf, off, A.RUNS)
    h = A.hashes(buf, starts, ends, folded=True)
    return (np.concatenate([three, h]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, A.rows_of(first)])


def train_text_model(evidence: DataFrame, sample: int = SAMPLE) -> TextModel:
    """The models of all languages that at least LEAST rows declare (of 26 ** 2 + 26 ** 3 possible tags)."""
    prepare(evidence.sparkSession)
    found = {r["declared"]: r["count"] for r in evidence.where("declared is not null").groupBy("declared").count().where(F.col("count") >= LEAST).collect()}
    languages = sorted(found)
    size = 1 << BITS
    if not languages:
        return TextModel([], np.zeros((1, size)))
    share = F.create_map(*[F.lit(x) for k, n in found.items() for x in (k, min(1.0, sample / n))])
    drawn = evidence.where(F.col("declared").isin(languages)).where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share[F.col("declared")] * (1 << 20))

    def count(batches):
        got: dict[str, np.ndarray] = {}
        for b in batches:
            named = b.column(0).to_pylist()
            for lo, hi, buf, off in A.chunks(b.column(1)):
                i, row = _grams(buf, off)
                each = np.bincount(row, minlength=hi - lo)
                weight = 1 / np.maximum(each, 1)  # every text counts alike
                for name in set(named[lo:hi]):
                    own = np.array([x == name for x in named[lo:hi]])
                    got.setdefault(name, np.zeros(size))
                    got[name] += np.bincount(i, np.where(own, weight, 0)[row], size)
        for name, n in got.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["language", "gram", "n"])

    sums = drawn.select("declared", "text").mapInArrow(count, "language string, gram long, n double").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    n = np.zeros((len(languages), size))
    sums = written(sums, "grams")
    for lo in range(0, len(languages), 16):  # 2 ** BITS rows a language at most
        part = sums.where(F.col("language").isin(languages[lo : lo + 16])).toArrow()
        place = {name: k for k, name in enumerate(languages)}
        at = np.array([place[x] for x in part["language"].dictionary_encode().combine_chunks().dictionary.to_pylist()], np.int64)
        which = part["language"].dictionary_encode().combine_chunks().indices.to_numpy()
        n[at[which] if len(which) else which, part["gram"].to_numpy()] = part["n"].to_numpy()
    mean = n.sum(1, keepdims=True)
    log = np.log((n + mean * 0.02 / size) / np.maximum(mean * 1.02, 1e-12)) if mean.all() else np.log((n + 1e-6) / (mean + 1e-6 * size))
    return TextModel(languages, np.vstack([log, np.full(size, -np.log(size))]))


def _text_scores(evidence: DataFrame, model: TextModel) -> DataFrame:
    """(id, declared, suffix, host, loglik, even, grams): weighted log-likelihoods of each language, and of even grams."""
    shared = prepare(evidence.sparkSession).sparkContext.broadcast(model.log.astype(np.float32))
    width = len(model.languages)
    rows = evidence.select("id", "text", "declared", "suffix", "host", *(["row"] if "row" in evidence.columns else []))
    out = StructType([StructField(k, t) for k, t in (("id", LongType()), ("declared", StringType()), ("suffix", StringType()), ("host", StringType()), ("loglik", ArrayType(DoubleType())), ("even", DoubleType()), ("grams", LongType()))] + rows.schema.fields[5:])

    def score(batches):
        log = shared.value
        for b in batches:
            z, n = np.zeros((b.num_rows, width + 1)), np.zeros(b.num_rows, np.int64)
            for lo, hi, buf, off in A.chunks(b.column(1)):
                i, row = _grams(buf, off)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                for k in range(width + 1):
                    z[lo:hi, k] = np.bincount(row, log[k][i], hi - lo)
            z *= (np.minimum(n, WEIGHT) / np.maximum(n, 1))[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(z[:, :width].ravel()))
            yield pa.record_batch([b.column(0), *(b.column(k) for k in (2, 3, 4)), lists, pa.array(z[:, width]), pa.array(n), *b.columns[5:]], names=out.names)

    scored = rows.mapInArrow(score, out)
    return scored.withColumn("p", F.expr(f"if(grams > 0, {_softmax('loglik')}, array_repeat(0D, {width}))"))


def _softmax(x: str) -> str:
    return f"transform(transform({x}, v -> exp(v - array_max({x}))), (e, i) -> e / aggregate(transform({x}, v -> exp(v - array_max({x}))), 0D, (s, v) -> s + v))"


def identify(evidence: DataFrame, model: TextModel, prior_rows: float = PRIOR_ROWS, accept: float = ACCEPT) -> DataFrame:
    """(id, language, probability, text_language, declared, host, accepted) for every row of evidence, and ``row`` if it has that.

    Scores are written once, with the rows that are carried along: the sums and the fusion read them from there.
    """
    width, row = len(model.languages), ["row"] if "row" in evidence.columns else []
    if not width:
        said = F.col("declared").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        return evidence.select("id", F.when(said, F.col("declared")).alias("language"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_language"), "declared", "host", said.alias("accepted"), *row)
    names = F.array(*map(F.lit, model.languages))
    scored = written(_text_scores(evidence, model), "evidence")
    sums = F.array(*[F.sum(F.col("p")[k]) for k in range(width)])
    corpus = [x or 0.0 for x in scored.agg(sums.alias("c")).first()["c"]]
    total = sum(corpus)
    everywhere = F.array(*[F.lit((c + 1) / (total + width)) for c in corpus])

    def counted(by: str) -> DataFrame:
        """Sums for each value, to be broadcast where they are counted to be small; else rows meet them by a shuffle."""
        each = written(scored.where(F.col(by).isNotNull()).groupBy(by).agg(sums.alias(f"{by}_c")), by)
        return F.broadcast(each) if each.count() * 8 * (width + 8) <= SMALL else each

    kinds = F.lit(float(width))

    def smoothed(count: Column, towards: Column) -> Column:
        n = F.aggregate(count, F.lit(0.0), lambda s, v: s + v)
        return F.when(count.isNull(), towards).otherwise(F.zip_with(count, towards, lambda c, t: (c + prior_rows * t) / (n + prior_rows)))

    # how often a language's texts carry this declaration, towards any of as many as there are languages
    likely = F.zip_with("declared_c", F.array(*[F.lit(c + 2.0) for c in corpus]), lambda d, c: F.log((d + 2.0 / kinds) / c))
    fused = scored
    for by in ("declared", "suffix", "host"):
        fused = fused.join(counted(by), by, "left")
    own = F.zip_with("host_c", "p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    fused = fused.withColumn("prior", smoothed(own, smoothed(F.col("suffix_c"), everywhere)))
    fused = fused.withColumn("say", F.when(F.col("declared_c").isNull(), F.array_repeat(F.lit(0.0), width)).otherwise(likely))
    fused = fused.withColumn("z", F.expr("zip_with(zip_with(loglik, prior, (l, r) -> l + ln(r)), say, (l, r) -> l + r)"))
    fused = fused.withColumn("post", F.expr(_softmax("z"))).withColumn("best", F.expr("cast(array_position(post, array_max(post)) as int)"))
    of_text = F.expr("cast(array_position(p, array_max(p)) as int)")
    seen = (F.col("grams") > 0) & (F.array_max("post") >= accept) & (F.element_at("loglik", F.col("best")) > F.col("even"))
    said = ~seen & (F.col("grams") > 0) & F.col("declared").isNotNull() & ~F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False))
    return fused.select(
        "id",
        F.when(said, F.col("declared")).otherwise(F.element_at(names, F.col("best"))).alias("language"),
        F.when(said, 0.0).otherwise(F.array_max("post")).alias("probability"),
        F.when(F.col("grams") > 0, F.element_at(names, of_text)).alias("text_language"),
        "declared", "host",
        (seen | said).alias("accepted"),
        *row,
    )


def identify_documents(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Documents only, each with its ``row``; the text models are fitted on them and, if given, on pages."""
    own = evidence_of_documents(docs)
    model = train_text_model(own if pages is None else own.unionByName(evidence_of_pages(pages)))
    return identify(evidence_of_documents(docs, whole=True), model)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and pages (page_id), each with evidence of its own kind."""
    docs, pages = evidence_of_documents(table(spark, sf_dir, "documents")), evidence_of_pages(table(spark, sf_dir, "pages"))
    model = train_text_model(docs.unionByName(pages))
    found = identify(docs, model).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "*")
    return found.unionByName(identify(pages, model).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id"), "*")).drop("id")
