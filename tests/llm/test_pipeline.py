import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodestow.llm import queries


def test_queries_cover_the_operators():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert names == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, data, name):
    df = queries.queries()[name](spark, data)
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted((tuple(r) for r in found.fetchall()), key=str)


def test_pipeline(spark, data, tmp_path):
    docs = before = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.dtypes == before.dtypes
        assert 0.5 * docs.count() < after.count() <= docs.count()
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        assert after.where("n_chars <> length(text)").count() == 0
        docs = after
    assert docs.count() == docs.select("text").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == docs.count()
    got, whole = packed.agg(F.sum("length"), F.count("*")).first(), corpus_pipeline.run(spark, data).agg(F.sum("length"), F.count("*")).first()
    assert tuple(got) == tuple(whole)


def test_empty_tables(spark, data, tmp_path):
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, data, tmp_path):
    """Nulls in any column, repeated rows, ties, long texts and columns with clashing names go through every stage."""
    base = spark.read.parquet(f"{data}/documents.parquet")
    first = base.orderBy("doc_id").first()
    long = " ".join([first["text"]] * max(1, 1_200_000 // max(1, len(first["text"]))))
    odd = [(None, None, None, None, None), (None, first["text"], "en", None, 3), (None, first["text"], "en", None, 3), (first["doc_id"], first["text"], "xx", "other", 5), (first["doc_id"], first["text"], "xx", "other", 5), (-1, "", "en", "s", 0), (-2, " \n\t", None, None, None), (-3, long, first["lang"], first["source"], len(long)), (-4, None, "de", "s", 1)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("_", "__", "_stay", "stay", "row", "key", "node", "label", "row_", "id", "score", "language", "accepted"))])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.dtypes == docs.dtypes, name
        assert after.where("`_` <> 0 or `_stay` <> 2 or `row` <> 4 or accepted <> 12").count() == 0
        docs, kept[name] = after, after.count()
        if name == "language_id":
            assert docs.where("trim(coalesce(text, '')) = ''").count() == 0
    again = corpus_pipeline.STAGES[3][1](spark, spark.read.parquet(f"{tmp_path}/line_dedup").repartition(7), data)
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))  # whichever way the rows lie
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.agg(F.sum("length")).first()[0] > 0
