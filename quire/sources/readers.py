"""Readers of the pipeline's files into its tables. Fields that a file lacks get their defaults; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.candidates import read_dossier

PAGES_JSON = "source string, pdf_type string, total_pages int, metadata map<string,string>, pages array<struct<page_number:int,pdf_type:string,raw_text:string,raw_text_pre:string>>"
SHOT = (
    ("start", "double", 0.0), ("end", "double", 0.0), ("visual", "string", "archive"), ("search_query", "string", ""), ("source_hint", "string", "any"), ("motion", "string", "static"),
    ("motion_intensity", "double", 0.5), ("typography_template", "string", None), ("typography_text", "string", ""), ("caption_text", "string", ""), ("show_caption", "boolean", True),
    ("note", "string", ""), ("section_id", "string", ""),
)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``, a file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pages_json(spark: SparkSession, path: str) -> DataFrame:
    """Pages of saved books: ``(book_id, source_path, page_no, pdf_type, raw_text, raw_text_pre)``; the file's name is the id."""
    j = spark.read.schema(PAGES_JSON).json(path, multiLine=True).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:_phase1a)?\.json$", 1).alias("book_id"))
    p = j.select("book_id", F.col("source").alias("source_path"), F.col("pdf_type").alias("book_type"), F.explode("pages").alias("p"))
    return p.select("book_id", "source_path", F.col("p.page_number").alias("page_no"), F.coalesce("p.pdf_type", "book_type").alias("pdf_type"), F.coalesce("p.raw_text", F.lit("")).alias("raw_text"), F.coalesce("p.raw_text_pre", F.lit("")).alias("raw_text_pre"))


def corrected_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files that users corrected, each one scanned page with the number 1."""
    x = whole_texts(spark, path)
    return x.select(F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1).alias("book_id"), F.lit(1).alias("page_no"), F.lit("scanned").alias("pdf_type"), F.col("text").alias("raw_text"))


def marked_pages(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts with ``--- Page N ---`` lines as pages: ``(key, page_no, raw_text)``; what precedes the first mark is page 0."""
    part = F.explode(F.filter(F.split(text, r"(?=--- Page \d+ ---)"), lambda p: T.strip(p) != ""))
    x = texts.select(key, part.alias("p"))
    no = F.regexp_extract("p", r"^--- Page (\d+) ---", 1)
    return x.select(key, F.when(no == "", 0).otherwise(no.cast("int")).alias("page_no"), T.strip(F.regexp_replace("p", r"^--- Page \d+ ---", "")).alias("raw_text"))


def _shot(c: Column) -> list[Column]:
    return [F.coalesce(c[n], F.lit(d).cast(t)).alias(n) if d is not None else c[n].alias(n) for n, t, d in SHOT]


def parse_plans(documents: DataFrame, key: str, document: str = "document") -> DataFrame:
    """Shot plans from JSON arrays: ``(key, shot_no, …)``; a document that is no JSON array gives no rows."""
    fields = ",".join(f"`{n}`:{t}" for n, t, _ in SHOT)
    x = documents.select(key, F.posexplode(F.from_json(document, f"array<struct<{fields}>>")).alias("i", "s")).where("s IS NOT NULL")
    return x.select(key, (F.col("i") + 1).alias("shot_no"), *_shot(F.col("s")))


def shot_plans(spark: SparkSession, path: str) -> DataFrame:
    x = whole_texts(spark, path).withColumn("plan_id", F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1))
    return parse_plans(x, "plan_id", "text")


def dossiers(spark: SparkSession, path: str) -> DataFrame:
    x = whole_texts(spark, path).select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("plan_id"), F.col("text").alias("document"))
    return read_dossier(x)


def photo_bank(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder by name: ``(name, length, content)``."""
    x = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp,tif,tiff}").option("recursiveFileLookup", "true").load(path)
    return x.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "content")


def zipped_photos(spark: SparkSession, path: str) -> DataFrame:
    """Image files in ZIP archives: ``(archive, name, length, content)``; an archive that can't be read gives no rows."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for n in sorted(z.namelist()):
                            if n.lower().endswith((".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff")):
                                data = z.read(n)
                                yield pd.DataFrame({"archive": [archive], "name": [n.rsplit("/", 1)[-1]], "length": [len(data)], "content": [data]})
                except zipfile.BadZipFile:
                    continue

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(each, "archive string, name string, length long, content binary")


def archive_hits(raw: DataFrame, source: str, n: int = 3) -> DataFrame:
    """Search answers of one archive as candidates: its own filters, then the first ``n`` of each query.

    ``raw``: (query, ord, title, url, license, mime, width, height). The archives differ in what they check."""
    from quire.operators.candidates import big_enough

    ok = {
        "loc": T.is_free_license(F.col("license")) & ~F.coalesce(F.col("url").rlike("thumb|150|200"), F.lit(False)),
        "wikimedia": big_enough() & T.is_free_license(F.col("license")),
        "internet_archive": F.lit(True),
        "pexels": F.col("url").isNotNull(),
    }[source]
    from pyspark.sql import Window

    x = raw.where(ok).withColumn("__k", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).where(F.col("__k") <= n).drop("__k")
    return x.withColumn("source", F.lit(source))


def read_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and blank lines skipped, quotes taken off."""
    out = {}
    for line in text.splitlines():
        k, eq, v = line.strip().partition("=")
        if eq and not k.startswith("#"):
            out.setdefault(k.strip(), v.strip().strip("\"'"))
    return out


def pdf_pages(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """Pages of PDF files: ``(book_id, page_no, pdf_type, raw_text, metadata, error)``.

    ``extract``: bytes -> (metadata, [text of each page]); by default an optional PDF library, without which every file gives one
    row with an error. A page with under 100 characters, or in a font whose letters can't be read, is to be scanned."""
    from collections.abc import Iterator

    import pandas as pd

    def library(data: bytes):
        import fitz

        doc = fitz.open(stream=data, filetype="pdf")
        return {k: str(doc.metadata.get(k) or "") for k in ("title", "author", "subject", "creator")}, [p.get_text() for p in doc]

    read = extract or library

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                book = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    meta, texts = read(content)
                    rows += [(book, i, t, meta, None) for i, t in enumerate(texts, 1)]
                except Exception as e:  # one file's failure is its own
                    rows.append((book, None, None, {}, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["book_id", "page_no", "raw_text", "metadata", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    x = files.mapInPandas(each, "book_id string, page_no int, raw_text string, metadata map<string,string>, error string")
    t = F.col("raw_text")
    scanned = (F.length(T.strip(t)) < 100) | T.is_corrupted_font(t) | T.is_decomposed(t)
    return x.select("book_id", "page_no", F.when(t.isNotNull(), F.when(scanned, "scanned").otherwise("digital")).alias("pdf_type"), "raw_text", "metadata", "error")
