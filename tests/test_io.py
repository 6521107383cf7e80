import json
import zipfile

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.candidates import dossier_json
from quire.sources import archive, readers, sinks
from quire.streaming import pages as S


def test_readers(spark, tmp_path):
    (tmp_path / "b1_phase1a.json").write_text(json.dumps({"source": "s.pdf", "pdf_type": "scanned", "pages": [{"page_number": 1, "raw_text": "x"}, {"page_number": 2, "pdf_type": "digital"}]}))
    got = [tuple(r) for r in readers.pages_json(spark, str(tmp_path / "*.json")).orderBy("page_no").collect()]
    assert got == [("b1", "s.pdf", 1, "scanned", "x", ""), ("b1", "s.pdf", 2, "digital", "", "")]
    (tmp_path / "t.txt").write_text("head\n--- Page 3 ---\nabc\n--- Page 4 ---\n\n")
    x = readers.whole_texts(spark, str(tmp_path / "t.txt"))
    assert [tuple(r)[1:] for r in readers.marked_pages(x, "path").orderBy("page_no").collect()] == [(0, "head"), (3, "abc"), (4, "")]
    assert readers.corrected_text(spark, str(tmp_path / "t.txt")).first().book_id == "t"
    (tmp_path / "p1.plan").write_text('[{"start": 1, "end": 2.5, "visual": "map"}, {}]')
    rows = readers.shot_plans(spark, str(tmp_path / "p1.plan")).orderBy("shot_no").collect()
    assert [(r.plan_id, r.shot_no, r.start, r.visual, r.show_caption) for r in rows] == [("p1", 1, 1.0, "map", True), ("p1", 2, 0.0, "archive", True)]
    bad = spark.createDataFrame([("a", "no json"), ("b", None)], "k string, document string")
    assert readers.parse_plans(bad, "k").collect() == []
    assert readers.read_env("# c\nA=1\nB='x y'\n\nA=2") == {"A": "1", "B": "x y"}


def test_photos_and_dossier(spark, tmp_path):
    (tmp_path / "b.JPG").write_bytes(b"1")
    (tmp_path / "a.png").write_bytes(b"22")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/c.jpg", b"333")
        z.writestr("d/c.txt", b"no")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    assert [r.name for r in readers.photo_bank(spark, str(tmp_path)).collect()] == ["a.png"]
    assert [(r.name, r.length) for r in readers.zipped_photos(spark, str(tmp_path)).collect()] == [("c.jpg", 3)]
    shots = spark.createDataFrame([("p", 1, "map", "q"), ("p", 2, None, None)], "plan_id string, shot_no int, visual string, search_query string")
    cand = spark.createDataFrame([("p", 1, 1, "loc", "t")], "plan_id string, shot_no int, ord int, source string, title string")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "decisions.json").write_text(dossier_json(shots, cand).first().document)
    assert sorted(map(tuple, readers.dossiers(spark, str(tmp_path / "p")).collect())) == [("p", 1, "map", "q", 1), ("p", 2, "", "", 0)]


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|" + b"x" * 120)
    (tmp_path / "bad.pdf").write_bytes(b"!")

    def extract(data):
        if data == b"!":
            raise ValueError("empty")
        return {"title": "T"}, data.decode().split("|")

    rows = sorted(map(tuple, readers.pdf_pages(spark, str(tmp_path), extract).select("book_id", "page_no", "pdf_type", "error").collect()), key=str)
    assert rows == [("a", 1, "scanned", None), ("a", 2, "digital", None), ("bad", None, None, "ValueError: empty")]


def test_archive_source(spark):
    spark.dataSource.register(archive.ImageSearch)
    raw = spark.read.format("image_search").option("queries", "a|b").option("limit", 12).load()
    assert raw.count() == 24
    hits = readers.archive_hits(raw, "wikimedia", 2)
    assert hits.groupBy("query").count().where("count > 2").count() == 0
    assert hits.where(~T.is_free_license(F.col("license")) | (F.col("width") < 400)).count() == 0
    assert archive.over_fetch("loc", 10) == 25 and archive.over_fetch("internet_archive", 3) == 6
    assert spark.read.format("image_search").load().count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b/1", "نص"), ("b2", None)], "book_id string, text string")
    out = {r.book_id: r for r in sinks.write_documents(df, "book_id", "text", str(tmp_path / "o")).collect()}
    assert open(out["b/1"].path).read() == "نص" and out["b2"].bytes == 0
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "k string, part_no int")
    assert {r.name for r in sinks.part_names(parts, "k").collect()} == {"a.zip", "b_part_001.zip", "b_part_002.zip"}
    files = spark.createDataFrame([("x.zip", "1.txt", bytearray(b"a")), ("x.zip", "2.txt", bytearray(b"b"))], "archive string, name string, content binary")
    r = sinks.write_zip_parts(files, str(tmp_path / "z")).first()
    assert zipfile.ZipFile(r.path).namelist() == ["1.txt", "2.txt"] and r.n_files == 2


def test_streams(spark, tmp_path):
    rows = [("b", 1, "x =", "2024-01-01 00:00:00"), ("b", 1, "x =", "2024-01-01 01:00:00"), ("b", 2, "y", "2024-01-01 02:00:00"), ("c", 1, "z", "2024-01-02 00:00:00")]
    spark.createDataFrame(rows, "book_id string, page_no int, raw_text string, t string").withColumn("ingested_at", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "book_id string, page_no int, raw_text string, ingested_at timestamp"
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.table(name).collect()]

    assert len(run(S.dedupe_stream(read()), "once")) == 3
    assert sorted(run(S.open_footnotes(S.dedupe_stream(read())), "open")) == [("b", 1, False), ("b", 2, True), ("c", 1, False)]
    assert sorted(r[1:] for r in run(S.lines_per_window(read()), "lines", "complete")) == [(1, 1), (3, 3)]
