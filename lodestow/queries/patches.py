"""Patches between neighbouring documents: what is made, applied to the source, gives the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches as P
from ..registry import register
from . import table

_GROWS, _SAME = ("ips", "ips32"), ("aps", "ppf")


def _pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    a, b = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("b").alias("source")), d.select("doc_id", F.col("b").alias("target"))
    pairs = a.join(b, "doc_id").repartition("doc_id")  # however few pieces the table comes in
    if kind in _GROWS:  # cannot shorten: the target goes after the source
        pairs = pairs.withColumn("target", F.concat("source", "target"))
    if kind in _SAME:  # cannot change the size: the source is the target turned round
        pairs = pairs.withColumn("source", F.encode(F.reverse(F.hex("target")), "UTF-8")).withColumn("target", F.encode(F.hex("target"), "UTF-8"))
    return pairs


def _query(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir, kind)
        made = P.created(pairs, "doc_id", kind, keep=("source",))
        return P.applied(made, "doc_id").select("doc_id", "format", "ok", F.md5("bytes").alias("hash"))

    target = "a.text || b.text" if kind in _GROWS else "hex(encode(b.text))" if kind in _SAME else "b.text"
    register(f"patch_{kind}", f"select b.doc_id, '{kind}' as format, true as ok, md5({target}) as hash from documents a join documents b on b.doc_id = a.doc_id + 1")(query)


for _kind in ("ips", "ips32", "ups", "bps", "vcdiff", "aps", "ppf"):
    _query(_kind)


@register("patch_formats", "select format, count(*) as n from (select case doc_id % 4 when 0 then 'ips' when 1 then 'bps' when 2 then 'ups' end as format from documents) group by format")
def patch_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(F.lit("PATCH"), F.lit("BPS1"), F.lit("UPS1"), F.lit("none")), (F.col("doc_id") % 4 + 1).cast("int"))
    patch = F.encode(F.concat(head, F.lit(" and more")), "UTF-8")
    return table(spark, sf_dir, "documents").select(P.patch_format(patch).alias("format")).groupBy("format").agg(F.count("*").alias("n"))
