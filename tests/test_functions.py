import hashlib

import pytest
from pyspark.sql import functions as F

from lodestow.functions import digests, names, numbers


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'binary' if isinstance(v, bytes) else 'long'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (names.extension, "a/b.tar.GZ", "gz"), (names.extension, "a.b/c", ""), (names.stem, "x/y.part1.rar", "y.part1"), (names.directory, "a/b/c.x", "a/b"),
        (names.content_id, "0123456789ABCDEF0123456789abcdef.cnmt.nca", "0123456789abcdef0123456789abcdef"), (names.content_id, "short.nca", ""),
        (names.base_id, "0100abcd12345801", "0100ABCD12340000"), (names.base_id, "xyz", ""), (names.version_text, " ", "1.0.0"), (names.version_text, "v2.1", "2.1"), (names.version_text, None, "1.0.0"),
        (names.without_disc, "Game (Disc 2)", "Game"), (names.volume_key, "Game.PART01.rar", "game.rar"), (names.volume_key, "Game.7Z.1000", "game.7z"), (names.volume_key, "Game.iso", "game.iso"), (names.volume_part, "scan.001", None), (names.without_disc, "Game [Disk A]", "Game"), (names.volume_part, "set.7z.003", 3), (names.volume_part, "single.zip", None),
        (names.disc_id, "cdrom:SLUS_012.34;1", "SLUS01234"), (names.ci_key, "Straße", "STRASSE"), (names.without_forbidden, 'a:b*"c', "abc"),
        (numbers.size_bytes, "about 1.5 mb", 1572864), (numbers.size_bytes, "none", None), (numbers.msf_frames, "00:02:00", 150), (numbers.msf_frames, "x", None),
    ],
)
def test_texts(spark, f, given, want):
    assert one(spark, f(F.col("v")), v=given) == want


@pytest.mark.parametrize(
    "f, given, want",
    [(numbers.msf_text, 150, "00:02:00"), (numbers.to_bcd, 59, 0x59), (numbers.from_bcd, 0x59, 59), (lambda c: numbers.align_up(c, 16), 17, 32), (lambda c: numbers.align_up(c, 16), 16, 16),
     (numbers.size_text, 1536, "1.5 KB"), (numbers.size_text, 3 << 30, "3.0 GB"), (numbers.size_text, 12, "12 B"), (numbers.index_shift, (1 << 31) - 1, 0), (numbers.index_shift, 1 << 31, 1), (numbers.index_shift, 1 << 33, 3)],
)
def test_numbers(spark, f, given, want):
    assert one(spark, f(F.col("v")), v=given) == want


@pytest.mark.parametrize(
    "data, crc, md5, sha1",
    [(b"", "00000000", "d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709"), (b"abc", "352441c2", "900150983cd24fb0d6963f7d28e17f72", "a9993e364706816aba3e25717850c26c9cd0d89d")],
)
def test_digests(spark, data, crc, md5, sha1):
    assert [one(spark, digests.digest(F.col("v"), m), v=data) for m in ("crc32", "md5", "sha1")] == [crc, md5, sha1]


def test_block_tree(spark):
    data = b"The quick brown fox." * 3
    leaves = one(spark, digests.block_hashes(F.col("v"), 16), v=data)
    want = [hashlib.sha256(data[i : i + 16].ljust(16, b"\0")).hexdigest() for i in range(0, 60, 16)]
    assert leaves == want
    assert one(spark, digests.hash_tree_root(digests.block_hashes(F.col("v"), 16)), v=data) == "50410a97425fe4f6a5d0f3b38a539b34c2afdfe655e46b17b8adce8cb6371bb9"
    assert one(spark, digests.block_hashes(F.col("v"), 16), v=b"") == []


def test_verification_zeroes_corrupt_blocks(spark):
    blocks = spark.createDataFrame([("a", 0, b"good"), ("a", 1, b"baad"), ("b", 0, b"none")], "id string, n int, bytes binary")
    want = spark.createDataFrame([("a", 0, hashlib.sha256(b"good").hexdigest()), ("a", 1, hashlib.sha256(b"good").hexdigest())], "id string, n int, sha256 string")
    got = {(r["id"], r["n"]): (r["ok"], bytes(r["bytes"])) for r in digests.verified_blocks(blocks, want, ["id", "n"]).collect()}
    assert got == {("a", 0): (True, b"good"), ("a", 1): (False, bytes(4)), ("b", 0): (False, b"none")}


def test_path_hash(spark):
    def plain(name, h=123456789):
        for c in name:
            h = ((h >> 5 | h << 27) & 0xFFFFFFFF) ^ ord(c)
        return h

    for name in ("", "a", "folder/Ünï.bin"):
        assert one(spark, digests.path_hash(F.col("v")), v=name) == plain(name)


def test_integers_of_bytes(spark):
    assert one(spark, numbers.little_endian(F.col("v"), 1, 4), v=b"\x00\xff\xff\xff\xff") == 0xFFFFFFFF
    assert one(spark, numbers.big_endian(F.col("v"), 0, 2), v=b"\x01\x02") == 258
    assert one(spark, numbers.big_endian(F.col("v"), 1, 2), v=b"\x01\x02") is None


def test_xml_and_entities(spark):
    from lodestow.sources import pages, texts

    df = spark.createDataFrame([("x", "<app><id>7</id><v/></app>")], "id string, text string")
    assert tuple(texts.xml_values(df, {"ident": "/app/id", "v": "/app/v", "none": "/app/no"}).first()) == ("x", "7", None, None)
    assert one(spark, pages.decoded(F.col("v")), v="a&amp;lt;b&nbsp;&quot;") == 'a&lt;b "'


def test_levels_compute_their_input_once(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from lodestow.functions import digests

    blocks = spark.range(40).select((F.col("id") % 2).alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("d"), (F.row_number().over(Window.partitionBy(F.col("id") % 2).orderBy("id")) - 1).alias("no"))
    got = digests.hash_levels(blocks, ["k"], "no", "d", 4)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["k"], r["level"], r["n"]) for r in got.groupBy("k", "level").agg(F.count("*").alias("n")).collect()) == [(k, x, n) for k in (0, 1) for x, n in ((0, 20), (1, 2), (2, 1), (3, 1))]
