import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestow.functions import patch_formats as P
from lodestow.operators import patches

SOURCE, TARGET = b"The quick brown fox.", b"The quack brown box!!"
FIXED = {
    "ips": "50415443480000060001610000100001620000130000000221454f46",
    "ips32": "4950533332000000060001610000001000016200000013000000022145454f46",
    "ups": "555053319495860800880400810f2100e558086ff497f5f3955b65fb",
    "bps": "42505331949580948161a0816284812183a6e558086ff497f5f3c8644af3",
    "aps": "41505331060000000161100000000162130000000121",
}


@pytest.mark.parametrize("kind", FIXED)
def test_fixed_vectors(spark, kind):
    rows = spark.createDataFrame([(1, SOURCE, bytes.fromhex(FIXED[kind]))], "id long, source binary, patch binary")
    for size in (4, 1 << 16):
        got = patches.applied(rows, "id", size=size).first()
        assert (got["format"], got["ok"], got["error"]) == (kind, True, None)
        assert bytes(got["bytes"]) == (TARGET[:20] if kind == "aps" else TARGET)


texts = st.binary(max_size=300)


def laid_over(patch, source):
    """A parsed patch applied by hand."""
    out = bytearray(source)
    if patch.target_size is not None:
        out = bytearray(bytes(out).ljust(patch.target_size, b"\0")[: patch.target_size])
    if patch.copies is not None:
        out = bytearray(patch.target_size)
        for at, n, place in patch.copies:
            out[at : at + n] = source[place : place + n]
    for at, data in patch.records:
        out.extend(bytes(max(0, at + len(data) - len(out))))
        old = out[at : at + len(data)]
        out[at : at + len(data)] = bytes(x ^ y for x, y in zip(old, data)) if patch.xor else data
    return bytes(out)


@settings(max_examples=150, deadline=None)
@given(texts, texts, st.integers(0, 5))
def test_formats_round_trip(a, b, shared):
    b = a[: len(a) * shared // 5] + b
    same = bytes(random.Random(len(b)).choices(b or b"x", k=len(a)))
    for kind, target in (("ips", a + b), ("ips32", a + b), ("ups", b), ("bps", b), ("vcdiff", b), ("aps", same), ("ppf", same)):
        e = P.Encoder(kind, (len(a), len(target)), (zlib.crc32(a), zlib.crc32(target)))
        for at, data in P.differences(kind, 0, a, target):
            e.add(at, data)
        assert laid_over(P.parsed(e.done(), kind), a) == target


def test_frames_round_trip(spark):
    """Objects of several blocks, made into patches and patched again."""
    rng = random.Random(5)
    rows = []
    for i in range(12):
        a = bytes(rng.choices(b"abcd", k=rng.randrange(0, 60)))
        b = bytes(rng.choices(b"abcd", k=len(a))) if i % 2 else a[:10] + b"zzzz" + a[14:]
        rows.append((i, a, b.ljust(len(a), b"q")[: len(a)]))
    df = spark.createDataFrame(rows, "id long, source binary, target binary")
    for kind in ("ips", "ips32", "ups", "aps", "ppf", "bps", "vcdiff"):
        made = patches.created(df, "id", kind, size=7).join(df.select("id", "source"), "id")
        got = {r["id"]: r for r in patches.applied(made, "id", size=7).collect()}
        assert {i: (r["ok"], bytes(r["bytes"])) for i, r in got.items()} == {i: (True, b) for i, _, b in rows}, kind


def ppf(version, records, image=0, check=None, undo=False, size=0):
    """A PPF file by its published layout."""
    head = b"PPF" + str(version).encode() + b"0" + bytes([version - 1]) + b"a description".ljust(50)
    if version == 2:
        head += size.to_bytes(4, "little") + check
    if version == 3:
        head += bytes([image, check is not None, undo, 0]) + (check or b"")
    return head + b"".join(o.to_bytes(8 if version == 3 else 4, "little") + bytes([len(d)]) + d + (b"?" * len(d) if undo else b"") for o, d in records)


def test_ppf_versions(spark):
    source = bytes(i * 7 % 251 for i in range(0xA000))
    check, other = source[0x9320 : 0x9320 + 1024], source[0x80A0 : 0x80A0 + 1024]
    recs = [(3, b"abc"), (0x9000, b"xyz")]
    want = bytearray(source)
    want[3:6], want[0x9000:0x9003] = b"abc", b"xyz"
    good = {"v1": ppf(1, recs), "v2": ppf(2, recs, check=check, size=len(source)), "v3": ppf(3, recs), "check": ppf(3, recs, check=check), "other": ppf(3, recs, image=1, check=other), "undo": ppf(3, recs, undo=True), "tail": ppf(3, recs) + b"@BEGIN_FILE_ID.DIZ text @END_FILE_ID.DIZ"}
    bad = {"size": ppf(2, recs, check=check, size=9), "wrong": ppf(3, recs, check=other), "beyond": ppf(3, [(0xA000 - 1, b"ab")]), "cut": ppf(3, recs)[:-1], "version": ppf(3, recs)[:5] + b"\x09" + ppf(3, recs)[6:]}
    rows = spark.createDataFrame([(k, source, v) for k, v in (good | bad).items()], "id string, source binary, patch binary")
    got = {r["id"]: r for r in patches.applied(rows, "id", size=5000).collect()}
    assert all(got[k]["ok"] and bytes(got[k]["bytes"]) == want for k in good)
    assert {k: got[k]["error"] for k in bad} == {"size": "source checksum", "wrong": "block check", "beyond": "outside the source", "cut": "truncated record", "version": "unknown version"}


def test_offset_that_spells_the_end():
    lo = 0x454F46 - 10
    a, b = bytes(40), bytes(10) + b"\x07" + bytes(29)
    assert list(P.differences("ips", lo, a, b)) == [(0x454F45, b"\0\x07")]


def bps(source, target, actions):
    out = b"BPS1" + P.to_varint(len(source)) + P.to_varint(len(target)) + P.to_varint(0) + actions + P._crc(source) + P._crc(target)
    return out + P._crc(out)


def test_copies_of_what_was_just_written(spark):
    """BPS and VCDIFF by hand: overlapping copies, copies of copies, moves back and forth in the source."""
    v = P.to_varint
    runs = bps(b"", b"ababab", v(1 << 2 | 1) + b"ab" + v(3 << 2 | 3) + v(0))
    source = b"0123456789"
    # "567" of the source, "012", then five of the target from its second byte on
    mixed = bps(source, b"56701267012", v(2 << 2 | 2) + v(5 << 1) + v(2 << 2 | 2) + v(8 << 1 | 1) + v(4 << 2 | 3) + v(1 << 1))
    # window over the whole source: copy 4 at 3 (mode self), add "xy", run of five z, copy 6 here from 10 + 4 (its own bytes)
    inst, data, addr = b"\x14" + b"\x03" + b"\x00\x05" + b"\x13\x06", b"xyz", bytes([3, 14])
    target = b"3456xyzzzzz" + b"xyzzzz"
    body = bytes([len(target), 0, len(data), len(inst), len(addr)]) + data + inst + addr
    vcd = b"\xd6\xc3\xc4\0\0\x01\x0a\x00" + bytes([len(body)]) + body
    # a copy that runs on over its own beginning, by an address before here
    inst2, addr2 = b"\x02" + b"\x23\x07", bytes([1])
    body2 = bytes([8, 0, 1, len(inst2), len(addr2)]) + b"q" + inst2 + addr2
    two = b"\xd6\xc3\xc4\0\0\x00" + bytes([len(body2)]) + body2
    rows = [("runs", b"", runs), ("mixed", source, mixed), ("window", source, vcd), ("here", b"", two), ("short", source[:5], vcd)]
    got = {r["id"]: r for r in patches.applied(spark.createDataFrame(rows, "id string, source binary, patch binary"), "id", size=3).collect()}
    assert {k: bytes(got[k]["bytes"]) for k in ("runs", "mixed", "window", "here")} == {"runs": b"ababab", "mixed": b"56701267012", "window": target, "here": b"q" * 8}
    assert (got["short"]["ok"], got["short"]["error"]) == (False, "outside the source")


def test_default_codes_of_vcdiff():
    """Codes that the specification's table names."""
    t = P._vcd_codes()
    assert len(t) == 256
    assert (t[0], t[1], t[18], t[19], t[20], t[34]) == ([("run", 0, 0)], [("add", 0, 0)], [("add", 17, 0)], [("copy", 0, 0)], [("copy", 4, 0)], [("copy", 18, 0)])
    assert (t[35], t[162], t[163], t[234], t[235], t[246], t[247], t[255]) == (
        [("copy", 0, 1)], [("copy", 18, 8)], [("add", 1, 0), ("copy", 4, 0)], [("add", 4, 0), ("copy", 6, 5)], [("add", 1, 0), ("copy", 4, 6)],
        [("add", 4, 0), ("copy", 4, 8)], [("copy", 4, 0), ("add", 1, 0)], [("copy", 4, 8), ("add", 1, 0)],
    )


def test_faults_are_rows(spark):
    good = bytes.fromhex(FIXED["ups"])
    rows = [("wrong source", SOURCE + b"x", good), ("truncated", SOURCE, good[:-3]), ("bad magic", SOURCE, b"nothing here"), ("none", SOURCE, None), ("short", SOURCE, b"PAT"), ("no source", None, bytes.fromhex(FIXED["ips"]))]
    got = {r["what"]: r for r in patches.applied(spark.createDataFrame(rows, "what string, source binary, patch binary"), "what").collect()}
    assert all(not r["ok"] and r["error"] and r["bytes"] is None for r in got.values()) and len(got) == 6
    assert got["bad magic"]["format"] is None
    made = patches.created(spark.createDataFrame([(1, b"abc", b"ab"), (2, b"a", None)], "id long, source binary, target binary"), "id", "ips").collect()
    assert all(r["patch"] is None for r in made) and {r["id"]: r["error"] for r in made} == {1: "the format cannot shorten", 2: "no source or no target"}


def test_ups_of_many_tasks(spark):
    """A patch has all of its records, however the tasks of an adaptive plan are put together."""
    rng = random.Random(3)
    rows = [(i, rng.randbytes(rng.randrange(1, 900)), rng.randbytes(rng.randrange(1, 900))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, source binary, target binary")
    confs = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {c: spark.conf.get(c) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        pairs = df.select("id", "source").join(df.select("id", "target"), "id")
        made = {r["id"]: bytes(r["patch"]) for r in patches.created(pairs, "id", "ups").collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert all(laid_over(P.parsed(made[i], "ups"), a) == b for i, a, b in rows)


def test_objects_that_are_rows_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, b"abcd" * 9, b"abxd" * 9)], "id long, source binary, target binary")
    made = patches.created(df, "id", "ppf", size=7, keep=("source",))
    out = patches.applied(made, "id", size=7)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    assert [(r["id"], r["ok"], bytes(r["bytes"])) for r in out.collect()] == [(1, True, b"abxd" * 9)]


def test_objects_that_are_blocks(spark):
    """Records of a patch over an object that comes as rows of blocks."""
    a, b = b"0123456789" * 5, b"01x3456789" * 4 + b"987654321012"
    for kind in ("ips", "ups"):
        made = patches.created(spark.createDataFrame([(1, a, b)], "id long, source binary, target binary"), "id", kind, size=7)
        recs = patches.records(made.select("id", "patch"), "id").select("id", "xor", F.inline("records")).select("id", "seq", "at", "data", "xor")
        blocks = spark.createDataFrame([(1, i, a[i * 7 : i * 7 + 7]) for i in range(8)], "id long, block_no long, bytes binary")
        out = patches.patched_blocks(blocks, recs, spark.createDataFrame([(1, len(b))], "id long, n long"), "id", size=7)
        assert b"".join(bytes(r["bytes"]) for r in sorted(out.collect(), key=lambda r: r["block_no"])) == b


def test_a_batch_neither_broadcasts_nor_sorts_what_has_not_been_dealt(spark):
    """Files of few bytes can be many rows; a replacement or a null path asks for no file."""
    files = [("a/One.bin", b"one"), ("b/one.bin", b"two"), ("c/x.dat", b"old"), ("c/y.dat", b"same")]
    ips = bytes.fromhex("5041544348") + bytes.fromhex("0000000001") + b"N" + b"EOF"
    batch = [("b/ONE.ips", ips), ("z/one.ips", ips), ("c/x.dat", b"new"), ("d/z.txt", b"own"), ("q/nowhere.ips", ips), (None, b"lost"), ("c/y.bps", b"BPS1 none")]
    kinds = "path string, content binary"
    tree, folder = spark.createDataFrame(files, kinds), spark.createDataFrame(batch, kinds)
    targets = patches.batch_targets(folder, tree, "path")
    assert {(r["path"], r["kind"], r["target"]) for r in targets.collect()} == {
        ("b/ONE.ips", "patch", "b/one.bin"), ("z/one.ips", "patch", "a/One.bin"), ("q/nowhere.ips", "patch", None), ("c/y.bps", "patch", "c/y.dat"),
        ("c/x.dat", "overwrite", "c/x.dat"), ("d/z.txt", "overwrite", "d/z.txt"), (None, "overwrite", None),
    }
    done = patches.batch_applied(tree, folder)
    assert {(r["path"], bytes(r["content"]), r["how"]) for r in done.collect()} == {
        ("a/One.bin", b"Nne", "patched"), ("b/one.bin", b"Nwo", "patched"), ("c/x.dat", b"new", "overwritten"), ("c/y.dat", b"same", "failed"), ("d/z.txt", b"own", "new"),
    }
    for df in (targets, done):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_the_query_joins_without_broadcasts(spark, data):
    from lodestow import registry

    done = registry.queries()["batch_applied"](spark, data)
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
