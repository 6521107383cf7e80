"""Queries that put books together: sections, chunks, exports, bundles; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.operators import chunking as C
from quire.operators import exports as X
from quire.session import table as t

from .sqlkit import CHUNKS, PAGES, WS, n_words, strip, token_est, words


def _chunk_pages(s, d):
    return tables.chunks(s, d).select("book_id", F.col("chunk_id").alias("page_no"), F.col("text").alias("raw_text"))


def book_sections(s, d):
    return C.sections(tables.pages(s, d))


def book_chunks(s, d):
    return C.chunk_pages(tables.pages(s, d))


def chunk_pages(s, d):
    """The pages that each chunk's lines stand on."""
    return C.chunk_pages(tables.pages(s, d), exact_pages=True).select("book_id", "chunk_id", "page_start", "page_end", "word_count")


def chunks_overlap(s, d):
    return C.chunk_pages(_chunk_pages(s, d))


def chunks_small(s, d):
    return C.chunk_pages(tables.pages(s, d), 200, 0)


def packed_documents(s, d):
    rows = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(C.pack(F.col("text"), 60, 14)))
    return rows.select("doc_id", F.col("pos").alias("ord"), F.col("col").alias("piece"))


def reader_groups(s, d):
    return C.reader_groups(tables.chunks(s, d), 3)


def bundle_parts(s, d):
    x = tables.pages(s, d).select("book_id", F.col("page_no").cast("long").alias("page_no"), F.coalesce(F.octet_length("raw_text"), F.lit(0)).cast("long").alias("size"))
    return C.bundle_parts(x, ["book_id"], "page_no", "size", 5000)


def raw_snapshot(s, d):
    return X.raw_snapshot(tables.pages(s, d), t(s, d, "book"))


def joined_text(s, d):
    return X.joined_text(tables.pages(s, d))


def pages_json(s, d):
    """The JSON written and read again."""
    schema = "source string, pdf_type string, total_pages int, pages array<struct<page_number:int,pdf_type:string,raw_text:string,raw_text_pre:string>>"
    j = X.pages_json(tables.pages(s, d), t(s, d, "book")).select("book_id", F.from_json("document", schema).alias("j"))
    return j.select("book_id", F.col("j.source").alias("source"), F.inline("j.pages"))


def chunks_text(s, d):
    return X.chunks_text(tables.chunks(s, d))


def chunks_json(s, d):
    schema = "chunk_count long, chunks array<struct<chunk_id:int,chapter:string,page_start:int,page_end:int,word_count:int,token_est:int,text:string>>"
    j = X.chunks_json(tables.chunks(s, d)).select("book_id", F.from_json("document", schema).alias("j"))
    return j.select("book_id", F.col("j.chunk_count").alias("chunk_count"), F.inline("j.chunks"))


def titled_text(s, d):
    return X.titled_text(tables.pages(s, d))


def page_types(s, d):
    """Type of each book by its pages: digital, scanned, or mixed."""
    n, k = F.count("*"), F.count_if(F.col("pdf_type") == "scanned")
    dig = F.count_if(F.col("pdf_type") == "digital")
    kind = F.when(dig == n, "digital").when(k == n, "scanned").otherwise("mixed")
    return tables.pages(s, d).groupBy("book_id").agg(n.alias("n_pages"), k.alias("n_scanned"), kind.alias("kind"))


def book_totals(s, d):
    from quire.functions import text as T

    w = T.n_words(F.col("text"))
    return tables.chunks(s, d).groupBy("book_id").agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(w), F.lit(0)).alias("n_words"), F.coalesce(F.sum(T.token_est(w)), F.lit(0)).alias("n_tokens"))


def _pack(x: str, max_tokens: int, overlap: int) -> str:
    most, lap = int(max_tokens / 1.4), int(overlap / 1.4)

    def fold(sep: str) -> str:
        q = f"chr(10) || chr(10)" if sep == "\n\n" else "chr(10)" if sep == "\n" else f"'{sep}'"
        cand = f"(CASE WHEN acc[-1] <> '' THEN acc[-1] || {q} || b[1] ELSE b[1] END)"
        tail = f"array_to_string({words('acc[-1]')}[-{lap}:], ' ')" if lap else "''"
        fresh = f"(CASE WHEN coalesce({tail}, '') <> '' THEN {strip(tail + " || ' ' || b[1]")} ELSE b[1] END)"
        return f"""list_filter(list_reduce(list_transform(string_split({x}, {q}), lambda pt: [pt]), lambda acc, b: CASE WHEN {n_words(cand)} <= {most} THEN acc[:-2] || [{cand}]
          WHEN acc[-1] <> '' THEN acc || [{fresh}] ELSE acc[:-2] || b END, ['']), lambda pc: pc <> '')"""

    tests = " ".join(f"WHEN contains({x}, {'chr(10) || chr(10)' if s == chr(10) * 2 else 'chr(10)' if s == chr(10) else repr(s)}) THEN {fold(s)}" for s in C.SEPARATORS)
    return f"(CASE WHEN {token_est(n_words(x))} <= {max_tokens} THEN [{x}] {tests} ELSE [{x}] END)"


def _sections(src: str) -> str:
    return f"""
pg AS (SELECT * FROM {src} WHERE {strip('raw_text')} <> ''),
sl AS (SELECT book_id, page_no, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM pg),
sh AS (SELECT *, NOT regexp_matches(line, '[.،؛؟!]') AND regexp_matches(line, '^.{{4,60}}{WS}*$') AS is_head FROM sl),
si AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY page_no, i ROWS UNBOUNDED PRECEDING) AS h FROM sh),
sb AS (SELECT book_id, h, {strip("coalesce(string_agg(line, chr(10) ORDER BY page_no, i) FILTER (NOT is_head), '')")} AS body, {strip('max(line) FILTER (is_head)')} AS title FROM si GROUP BY book_id, h),
sn AS (SELECT *, coalesce(sum(CASE WHEN body <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
  sum(CASE WHEN body <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id) AS total FROM sb),
sp AS (SELECT *, n = total AS trl, CASE WHEN n = total AND total > 0 THEN total - 1 ELSE n END AS sec_no,
  CASE WHEN h = 0 THEN body WHEN body <> '' THEN title || chr(10) || chr(10) || body ELSE title END AS part FROM sn WHERE h > 0 OR body <> ''),
sg AS (SELECT book_id, sec_no, string_agg(part, chr(10) || chr(10) ORDER BY h) AS text, arg_max(coalesce(title, 'intro'), h) FILTER (NOT trl) AS chapter, max(h) AS last_h, max(total) AS total FROM sp GROUP BY book_id, sec_no),
sections AS (SELECT book_id, CAST(sec_no AS INTEGER) AS sec_no, CASE WHEN total = 0 OR (last_h = 0 AND count(*) OVER (PARTITION BY book_id) = 1) THEN 'full_book' ELSE chapter END AS chapter, text FROM sg)"""


def _chunked(src: str, max_tokens: int, overlap: int) -> str:
    return f"""WITH {_sections(src)},
ca AS (SELECT book_id, sec_no, chapter, {_pack('text', max_tokens, overlap)} AS a FROM sections),
cp AS (SELECT book_id, sec_no, chapter, {strip('p')} AS piece, i FROM (SELECT *, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM ca)),
cr AS (SELECT *, CASE WHEN {n_words('piece')} >= 8 THEN 1 ELSE 0 END AS r FROM cp),
cn AS (SELECT *, coalesce(sum(r) OVER (PARTITION BY book_id ORDER BY sec_no, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n, sum(r) OVER (PARTITION BY book_id) AS total FROM cr),
cc AS (SELECT *, CAST(greatest(least(n, total - 1), 0) AS INTEGER) AS chunk_id FROM cn),
cg AS (SELECT book_id, chunk_id, string_agg(piece, chr(10) || chr(10) ORDER BY sec_no, i) AS text, coalesce(arg_max(chapter, {{'a': sec_no, 'b': i}}) FILTER (r = 1), 'intro') AS chapter FROM cc GROUP BY ALL),
sx AS (SELECT book_id, min(page_no) AS page_start, max(page_no) AS page_end FROM pg GROUP BY book_id)
SELECT book_id, chunk_id, chapter, page_start, page_end, {n_words('text')} AS word_count, {token_est(n_words('text'))} AS token_est, text FROM cg JOIN sx USING (book_id)"""


_BOOK = "(SELECT book_id, arg_min({'source_path': source_path, 'pdf_type': pdf_type, 'total_pages': total_pages, 'title': metadata['title'], 'author': metadata['author']}, ingested_at) AS r FROM book GROUP BY book_id)"
_CP = f"(SELECT book_id, chunk_id AS page_no, text AS raw_text FROM {CHUNKS})"

ORACLE = {
    "book_sections": f"WITH {_sections(PAGES)} SELECT * FROM sections",
    "book_chunks": _chunked(PAGES, 1500, 200),
    "chunks_overlap": _chunked(_CP, 1500, 200),
    "chunks_small": _chunked(PAGES, 200, 0),
    "packed_documents": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, piece FROM (SELECT doc_id, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, {_pack('text', 60, 14)} AS a FROM documents WHERE text IS NOT NULL))",
    "reader_groups": f"""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chunk_id) - 1 AS k, count(*) OVER (PARTITION BY book_id) AS n FROM {CHUNKS} WHERE text IS NOT NULL)
SELECT book_id, CAST(k // greatest(1, n // 3) AS INTEGER) AS group_no, count(*) AS n_chunks, string_agg(text, chr(10) || chr(10) ORDER BY chunk_id)[:3000] AS text FROM k GROUP BY ALL""",
    "bundle_parts": f"""
WITH RECURSIVE x AS (SELECT book_id, CAST(page_no AS BIGINT) AS page_no, coalesce(strlen(raw_text), 0) AS size, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS rn FROM {PAGES}),
r AS (SELECT book_id, page_no, size, rn, 1 AS part_no, size AS used FROM x WHERE rn = 1
  UNION ALL SELECT x.book_id, x.page_no, x.size, x.rn, CASE WHEN r.used > 0 AND r.used + x.size > 5000 THEN r.part_no + 1 ELSE r.part_no END, CASE WHEN r.used > 0 AND r.used + x.size > 5000 THEN x.size ELSE r.used + x.size END
  FROM r JOIN x ON x.book_id = r.book_id AND x.rn = r.rn + 1)
SELECT book_id, page_no, size, part_no FROM r""",
    "raw_snapshot": f"""
WITH p AS (SELECT book_id, string_agg('[Page ' || printf('%03d', page_no) || ' | ' || coalesce(pdf_type, 'None') || ']' || chr(10) || coalesce(nullif(raw_text_pre, ''), '(empty)') || chr(10) || repeat('═', 60), chr(10) ORDER BY page_no) AS body FROM {PAGES} GROUP BY book_id)
SELECT book_id, '# RAW EXTRACT — ' || regexp_extract(r.source_path, '([^/]*)$') || chr(10) || '# PDF Type   : ' || coalesce(r.pdf_type, 'N/A') || chr(10) || '# Total pages: ' || coalesce(CAST(r.total_pages AS VARCHAR), 'N/A') || chr(10)
  || '# Title      : ' || coalesce(r.title, 'N/A') || chr(10) || '# Author     : ' || coalesce(r.author, 'N/A') || chr(10) || chr(10) || body AS document FROM {_BOOK} JOIN p USING (book_id)""",
    "joined_text": f"SELECT book_id, string_agg({strip('raw_text')}, chr(10) || chr(10) ORDER BY page_no) AS text FROM {PAGES} WHERE {strip('raw_text')} <> '' GROUP BY book_id",
    "pages_json": f"SELECT book_id, r.source_path AS source, page_no AS page_number, p.pdf_type, coalesce(raw_text, '') AS raw_text, coalesce(raw_text_pre, '') AS raw_text_pre FROM {PAGES} p JOIN {_BOOK} USING (book_id)",
    "chunks_text": f"SELECT book_id, count(*) AS n_chunks, string_agg({strip('text')}, chr(10) || chr(10) ORDER BY chunk_id) AS text FROM {CHUNKS} WHERE {strip('text')} <> '' GROUP BY book_id",
    "chunks_json": f"SELECT book_id, count(*) OVER (PARTITION BY book_id) AS chunk_count, chunk_id, chapter, page_start, page_end, word_count, token_est, text FROM {CHUNKS}",
    "titled_text": f"SELECT book_id, string_agg('=== ' || book_id || ' — Page ' || page_no || ' ===' || chr(10) || coalesce(raw_text, ''), chr(10) || chr(10) ORDER BY page_no) AS document FROM {PAGES} GROUP BY book_id",
    "page_types": f"""SELECT book_id, count(*) AS n_pages, count(*) FILTER (pdf_type = 'scanned') AS n_scanned, CASE WHEN count(*) FILTER (pdf_type = 'digital') = count(*) THEN 'digital'
  WHEN count(*) FILTER (pdf_type = 'scanned') = count(*) THEN 'scanned' ELSE 'mixed' END AS kind FROM {PAGES} GROUP BY book_id""",
    "book_totals": f"SELECT book_id, count(*) AS n_chunks, CAST(coalesce(sum({n_words('text')}), 0) AS BIGINT) AS n_words, CAST(coalesce(sum({token_est(n_words('text'))}), 0) AS BIGINT) AS n_tokens FROM {CHUNKS} GROUP BY book_id",
}
QUERIES = {k: globals()[k] for k in (*ORACLE, "chunk_pages")}
