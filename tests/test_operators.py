import pytest
from pyspark.sql import functions as F

from lodestow.operators import blocks, catalog, layers, matching, ordered


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_and_last_by_order_not_by_arrival(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, None)], "k string, ord int, v string")
    for part in (df, df.orderBy(F.desc("ord")), df.repartition(3)):
        assert rows(catalog.first_by(part, ["k"], [F.col("ord")])) == [("k", 1, "a")]
        assert rows(catalog.last_by(part, ["k"], [F.col("ord")])) == [("k", 3, None)]


def test_require_unique(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert catalog.require_unique(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        catalog.require_unique(df.union(df), ["k"]).collect()


def test_contiguous(spark):
    df = spark.createDataFrame([("full", 1), ("full", 2), ("gap", 1), ("gap", 3), ("twice", 1), ("twice", 1), ("single", None)], "g string, p int")
    assert {r["g"]: r["complete"] for r in catalog.contiguous(df, ["g"], "p").collect()} == {"full": True, "gap": False, "twice": False, "single": True}


def test_allowed_or_blank(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (" ",)], "id string")
    assert rows(matching.allowed_or_blank(df, df.where("id = 'a'"), "id")) == [(" ",), ("a",), (None,)]


def test_read_ranges_and_seek_index(spark):
    data = bytes(range(100))
    b = blocks.chunks(spark.createDataFrame([("o", data)], "obj_id string, bytes binary"), "obj_id", "bytes", 16)
    assert b.count() == 7
    reads = spark.createDataFrame([("o", 1, 0, 100), ("o", 2, 15, 17), ("o", 3, 90, 100), ("o", 4, 5, 5)], "obj_id string, read_no int, v_start long, v_end long")
    got = {r["read_no"]: bytes(r["bytes"]) for r in blocks.read_ranges(reads, b, "obj_id", 16).collect()}
    assert got == {1: data, 2: data[15:17], 3: data[90:]}
    index = blocks.seek_index(blocks.compressed(b), "obj_id").orderBy("block_no").collect()
    assert [r["packed_offset"] for r in index] == [sum(x["packed_size"] for x in index[:i]) for i in range(7)]
    broken = b.limit(1).select("obj_id", "block_no", F.lit(b"junk").alias("packed"), F.lit(False).alias("is_raw"))
    assert [(r["ok"], r["bytes"]) for r in blocks.decompressed(broken).collect()] == [(False, None)]


def test_coalesced_extents(spark):
    e = [("o", 0, 4, 100, 0), ("o", 4, 8, 104, 0), ("o", 8, 9, 200, 0), ("o", 9, 12, 201, 1), ("o", 20, 22, 212, 1)]
    got = ordered.coalesced_extents(spark.createDataFrame(e, "obj_id string, v_start long, v_end long, p_start long, src int"))
    assert rows(got) == sorted([("o", 0, 8, 100, 0), ("o", 8, 9, 200, 0), ("o", 9, 12, 201, 1), ("o", 20, 22, 212, 1)], key=str)


def test_overlay(spark):
    e = spark.createDataFrame([("a", False, 0), ("a/x", False, 1), ("b", True, 0), ("b/y", False, 1), ("b/y", False, 2)], "path string, is_dir boolean, layer int")
    assert rows(layers.without_shadowed(e).select("path", "is_dir", "layer")) == [("a", False, 0), ("b", True, 0), ("b/y", False, 1)]


def test_key_values(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 3, None, True)], "key string, seq int, value string, deleted boolean")
    assert rows(layers.snapshot(log)) == [("a", 2, "y", False)]
    new = layers.published(spark.createDataFrame([("s", 7)], "space string, id int"), spark.createDataFrame([("s", "p"), ("s", "q"), ("t", "r")], "space string, name string"), "id", [F.col("name")], ["space"])
    assert {(r["name"], r["id"]) for r in new.collect()} == {("p", 8), ("q", 9), ("r", 1)}
    assert [r["key"] for r in layers.lower_bound(log, "key", "b").collect()] == ["b", "b"]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "k string, o long, v long")
    assert catalog.first_by(none, ["k"], [F.col("o")]).count() == 0
    assert ordered.sequential_bins(none, ["k"], "o", "v", 10).count() == 0
    assert ordered.runs(none, ["k"], "o").count() == 0
    assert ordered.debounced(none, ["k"], "o", 1, "v").count() == 0


def test_chains_with_gaps_and_circles(spark):
    from lodestow.operators import chains

    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 8), (20, 21), (21, 20)], "k long, before long")
    assert rows(chains.positions(df, "k", "before")) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3)]


def test_hashed_layout(spark):
    import hashlib

    from lodestow.operators import containers

    df = spark.createDataFrame([("c", "b.bin", b"xyz"), ("c", "a.bin", b"q" * 600)], "c string, name string, data binary")
    got = {r["name"]: r for r in containers.hashed_layout(df, "c", "name", "data").collect()}
    assert (got["b.bin"]["data_offset"], got["a.bin"]["sha256"], got["a.bin"]["header_size"]) == (600, hashlib.sha256(b"q" * 512).hexdigest(), 16 + 2 * 64 + 16)


def test_names_of_any_length_are_searched_by_stretches(spark):
    """Targets at every place of names around the stretches' edges, and hashes as compiled code, not within arrays."""
    from pyspark.sql import functions as F

    from lodestow.operators import matching

    target = "0123456789ABCDEFGHIJ"
    names = ["é" * n + "q" * i + target + "z" * (i % 3) for n in (0, 20) for i in range(150)] + ["q" * 200 + target[:-1], target[:5], "", target[:16]]
    found = matching.contained(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(target,)], "t string"), "name", "t", grams=16)
    assert sorted(r["name"] for r in found.select("name").collect()) == sorted(names[:300])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(substring(_d" in plan
