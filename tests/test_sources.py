import io
import json
import zipfile

from pyspark.sql import functions as F

from lodestow.sources import files, pages, texts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else sorted(map(tuple, df.collect()), key=str)


def of(spark, text):
    return spark.createDataFrame([("x", text)], "id string, text string")


def test_cue(spark):
    cue = 'FILE "a.bin" BINARY\n  TRACK 01 MODE2/2352\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 00 00:02:00\r\n    INDEX 01 00:04:00\nFILE b.bin BINARY\nTRACK 03 AUDIO\nINDEX 01 00:00:10'
    got = rows(texts.cue_indexes(of(spark, cue)), "track", "index")
    assert got == [("x", "a.bin", 1, "MODE2/2352", 1, 0), ("x", "a.bin", 2, "AUDIO", 0, 150), ("x", "a.bin", 2, "AUDIO", 1, 300), ("x", "b.bin", 3, "AUDIO", 1, 10)]
    assert rows(texts.cue_files(of(spark, cue)), "nth") == [("x", 1, "a.bin"), ("x", 2, "b.bin")]


def test_gdi(spark):
    gdi = '3\n1 0 4 2352 "track 01.bin" 0\n2 600 0 2352 track02.raw 0\n3 45000 4 2352 track03.bin 0\n'
    got = rows(texts.gdi_tracks(of(spark, gdi)), "number")
    assert got == [("x", 1, 0, 4, 2352, "track 01.bin", 0, True), ("x", 2, 600, 0, 2352, "track02.raw", 0, True), ("x", 3, 45000, 4, 2352, "track03.bin", 0, True)]
    assert {r["complete"] for r in texts.gdi_tracks(of(spark, gdi.replace("3\n1", "4\n1"))).collect()} == {False}


def test_dat(spark):
    dat = "rom1.bin\trom1_ko\tCRC(352441C2)\nrom2.bin\tp2\n\nrom3.bin\tnot read\n[en_US]\nTitle\n[ko_KR]\nLocal title"
    assert rows(texts.dat_entries(of(spark, dat)), "ord") == [("x", 0, "rom1.bin", "rom1_ko", "352441c2"), ("x", 1, "rom2.bin", "p2", None)]
    assert rows(texts.dat_title(of(spark, dat))) == [("x", "Local title")]
    assert rows(texts.dat_title(of(spark, "[en_US]\nTitle"))) == [("x", "Title")]


def test_ini_and_playlist(spark):
    assert rows(texts.ini_values(of(spark, '; note\n[main]\nkey="v1"\nkey="v2"\nother = a=b\n'))) == [("x", "main", "key", "v2"), ("x", "main", "other", "a=b")]
    m3u = spark.createDataFrame([("x", "# comment\ndisc1.cue\n\nsub/disc2.cue\n/abs.cue", "/games/")], "id string, text string, dir string")
    assert rows(texts.playlist(m3u, folder="dir"), "nth") == [("x", 1, "/games/disc1.cue"), ("x", 2, "/games/sub/disc2.cue"), ("x", 3, "/abs.cue")]


def test_track_fields(spark):
    assert of(spark, "TRACK:1 TYPE:AUDIO  FRAMES:300").select(texts.track_fields("text").alias("m")).first()["m"] == {"TRACK": "1", "TYPE": "AUDIO", "FRAMES": "300"}


def test_empty_texts(spark):
    none = spark.createDataFrame([("a", None), ("b", "")], "id string, text string")
    for f in (texts.cue_indexes, texts.cue_files, texts.gdi_tracks, texts.dat_entries, texts.dat_title, texts.ini_values, texts.playlist):
        assert f(none).collect() == []


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.zip").write_bytes(_zip({"p/one.txt": b"1", "in.zip": _zip({"two.txt": b"22"})}))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    found = files.tree(spark, str(tmp_path), "*.zip", content=True)
    assert sorted(r["name"] for r in found.collect()) == ["a.zip", "b.zip"]
    got = {(r["entry"], bytes(r["bytes"]) if r["bytes"] is not None else None) for r in files.zip_entries(found.select("name", "content"), "name").where("error is null").collect()}
    assert got == {("p/one.txt", b"1"), ("in.zip/two.txt", b"22")}
    assert files.zip_entries(found.select("name", "content"), "name").where("error is not null").count() == 1
    broken = _zip({"t.txt": b"t" * 50})
    broken = broken[:-30] + b"?" * 30
    odd = spark.createDataFrame([("o.zip", _zip({"in.zip": broken, "z.zip": b"PK no archive"}))], "name string, content binary")
    assert {(r["entry"], bytes(r["bytes"])) for r in files.zip_entries(odd, "name").collect()} == {("in.zip", broken), ("z.zip", b"PK no archive")}
    scoped = files.scoped(spark.createDataFrame([("p/one",), ("q",)], "entry string"), "p/")
    assert [r["entry"] for r in scoped.collect()] == ["one"]
    tree = files.directories(spark.createDataFrame([("a/b/c.txt",), ("a/d.txt",)], "path string"))
    assert rows(tree) == [("a", None), ("a/b", "a")]


def test_hidden_files_stay_hidden(spark, tmp_path):
    for name in ("a.txt", ".b.txt", ".git/c.txt", "sub/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r["name"] for r in files.tree(spark, str(tmp_path)).collect()) == ["a.txt", "d.txt"]


def test_json_table(spark, tmp_path):
    (tmp_path / "g.json").write_text("\n".join(json.dumps(x) for x in ({"id": "a", "eTitle": "A", "languages": ["en"]}, {"id": "b"})))
    assert files.json_table(spark, str(tmp_path), "id string, eTitle string, languages array<string>", "id").count() == 2


def test_links(spark):
    html = '<a href="/X.zip">x</a><i data-url="http://h/get?fname=my%20file.rar"></i><a HREF="/x.ZIP">again</a>'
    got = pages.links(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert rows(got, "nth") == [(1, 1, "/X.zip"), (1, 2, "http://h/get?fname=my%20file.rar")]
    assert [r[0] for r in got.orderBy("nth").select(pages.file_name(F.col("url"))).collect()] == ["X.zip", "my file.rar"]
    assert pages.prioritised(got, [("fname", 5)], [F.col("nth")]).first()["nth"] == 2


def test_ccd(spark):
    a = "[CloneCD]\nVersion=3\n[TRACK 1]\nMODE=1\nINDEX 1=0\n[TRACK 2]\nMODE=0\nINDEX 1=300\n[Entry 0]\nPoint=0x09\nPLBA=1\n"
    b = "[Entry 0]\nPoint=0xa0\nControl=0x04\nPLBA=4350\n[Entry 3]\nPoint=0x01\nControl=0x04\nPLBA=0\n[Entry 4]\nPoint=0x02\nControl=0x00\nPLBA=900\n"
    df = spark.createDataFrame([("a", a), ("b", b)], "id string, text string")
    assert rows(texts.ccd_tracks(df), "id", "track") == [("a", 1, 1, 0), ("a", 2, 0, 300), ("b", 1, 1, 0), ("b", 2, 0, 900)]


def test_gdi_written_and_read(spark):
    from lodestow.operators.containers import gdi_text

    tracks = [("d", 2, 600, 0, 2352, "track02.raw", 0), ("d", 1, 0, 4, 2352, "track 01.bin", 0)]
    df = spark.createDataFrame(tracks, "id string, number int, lba long, type int, sector int, file string, offset long")
    back = texts.gdi_tracks(gdi_text(df, "id"))
    assert sorted(map(tuple, back.drop("complete").collect())) == sorted(tracks) and back.where("not complete").count() == 0


def test_sheets_are_read_once(spark):
    """Settings are cut in the row, and both kinds of sections come from one reading."""
    text = "MODE=9\n[TRACK 2]\nMODE=1\nINDEX 1=5\n[]\nMODE=2\n; MODE=3\n[Entry 0]\nPOINT=0x01\nPLBA=7\n[TRACK 2]\nINDEX 1=6"
    df = spark.createDataFrame([("a", text), ("b", "[Entry 4]\nPoint=0x03\nControl=0x04\nPLBA=8\n[Entry 5]\nPOINT=0xa0"), ("c", ""), ("d", None)], "id string, text string")
    got = texts.ccd_tracks(df)
    assert rows(got, "id", "track") == [("a", 2, 2, 6), ("b", 3, 1, 8)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert rows(texts.ini_values(df).where("id = 'a' and section = ''"), "id") == [("a", "", "MODE", "9")]
