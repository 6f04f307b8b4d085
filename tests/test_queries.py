"""Every registered query against its SQL, on the smallest tables."""

from decimal import Decimal

import pytest

from lodestow import registry

SQL = registry.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, data, name):
    df = registry.queries()[name](spark, data)
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == want


def test_crc32(spark, data):
    import zlib

    rows = registry.queries()["hash_crc32"](spark, data).join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").collect()
    assert rows and all(int(r["hash"], 16) == zlib.crc32(r["text"].encode()) for r in rows)


def test_order_of_rows_does_not_matter(spark, data, tmp_path):
    """The same rows in other files and another order give the same result."""
    for t in ("orders", "customer", "lineitem"):
        rows = spark.read.parquet(f"{data}/{t}.parquet")
        rows.orderBy(*rows.columns).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("merge_plan", "latest_top1", "bin_pack"):
        q = registry.queries()[name]
        assert sorted(map(str, q(spark, data).collect())) == sorted(map(str, q(spark, str(tmp_path)).collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
