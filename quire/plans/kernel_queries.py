"""Queries through kernels with their stubs. The stubs are hashes of prompts, which SQL can tell as well for some."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators import chunking as C
from quire.operators import kernels as K
from quire.session import table as t

from .sqlkit import CHUNKS, SHOTS


def vision_scoring(s, d):
    x = tables.shots(s, d).where("search_query <> ''").select("plan_id", "shot_no", "search_query")
    v = K.vision_scores(F.col("answer"))
    return K.complete(x, F.col("search_query"), "vision").select("plan_id", "shot_no", v["subject"].alias("subject"), v["quality"].alias("quality"), v["cinematic"].alias("cinematic"))


def ocr_correction(s, d):
    """Scanned pages through a corrector that fails for some: these keep their text."""
    x = tables.pages(s, d).where("pdf_type = 'scanned'").where(T.strip(F.col("raw_text")) != "")
    return K.complete(x, F.col("raw_text"), "failing", F.col("raw_text")).select("book_id", "page_no", F.col("answer").alias("text"), F.col("error").isNotNull().alias("failed"))


def section_keywords(s, d):
    x = tables.chunks(s, d).where("text IS NOT NULL").select("book_id", "chunk_id", F.col("text").alias("p"))
    k = K.keywords(F.col("answer"))
    return K.complete(x, F.col("p"), "keywords").select("book_id", "chunk_id", *(F.array_join(k[c], "|").alias(c) for c in ("wikimedia", "pexels", "key_phrases")))


def script_revision(s, d):
    outlines = C.reader_groups(tables.chunks(s, d), 1, None).select("book_id", F.col("text").alias("outline"))
    return K.revise(outlines, "echo", "score").select("book_id", "total", "n_words", "retries")


def backend_chain(s, d):
    x = tables.shots(s, d).where("caption_text <> ''").select("plan_id", "shot_no", "caption_text")
    return K.first_backend(x, F.col("caption_text"), ["failing", "echo"]).groupBy("backend").agg(F.count("*").alias("n"), F.sum(F.size("errors")).alias("n_errors"))


def page_stitch(s, d):
    return K.stitch_pages(tables.pages(s, d).where("pdf_type = 'scanned'"), "stub")


def resilient_json(s, d):
    """Every plan's JSON, cut off at two thirds, salvaged."""
    shot = F.to_json(F.struct("shot_no", "visual", "search_query"))
    plans = tables.shots(s, d).groupBy("plan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shot_no", shot.alias("j")))), lambda x: x["j"]), ", ").alias("body"))
    raw = F.concat(F.lit('{"shots": ['), "body", F.lit("]}"))
    x = plans.select("plan_id", F.substring(raw, F.lit(1), F.floor(F.length(raw) * 2 / 3).cast("int")).alias("raw"))
    return K.salvaged_plans(x).select("plan_id", F.size("shots").alias("n_shots"))


def word_confusions(s, d):
    x = t(s, d, "documents").where("text IS NOT NULL")
    return x.select("doc_id", K.replace_words(F.col("text"), {"في": "فى", "the": "teh", "le": "la"}).alias("text"))


_V = "((instr('0123456789abcdef', md5(search_query)[{0}]) - 1) * 16 + instr('0123456789abcdef', md5(search_query)[{1}]) - 1) % 4"
ORACLE = {
    "vision_scoring": "SELECT plan_id, shot_no, "
    + ", ".join(f"CAST({_V.format(2 * i + 1, 2 * i + 2)} AS INTEGER) AS {c}" for i, c in enumerate(("subject", "quality", "cinematic")))
    + f" FROM {SHOTS} WHERE search_query <> ''",
    "word_confusions": "SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'في' THEN 'فى' WHEN 'the' THEN 'teh' WHEN 'le' THEN 'la' ELSE w END), ' ') AS text FROM documents WHERE text IS NOT NULL",
    "ocr_correction": """SELECT book_id, page_no, raw_text AS text, ((instr('0123456789abcdef', md5(raw_text)[1]) - 1) * 16 + instr('0123456789abcdef', md5(raw_text)[2]) - 1) % 4 = 0 AS failed
FROM (SELECT DISTINCT book_id, page_no, pdf_type, raw_text FROM page) WHERE pdf_type = 'scanned' AND regexp_matches(raw_text, '[^\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]')""",
    "section_keywords": f"""WITH w AS (SELECT book_id, chunk_id, list_filter(string_split_regex(text, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]+'), lambda x: x <> '')[:6] AS w FROM {CHUNKS} WHERE text IS NOT NULL)
SELECT book_id, chunk_id, coalesce(array_to_string(w[:4], '|'), '') AS wikimedia, coalesce(array_to_string(w[:3], '|'), '') AS pexels, coalesce(array_to_string(w[:2], '|'), '') AS key_phrases FROM w""",
}
ORACLE["resilient_json"] = f"""
WITH j AS (SELECT plan_id, shot_no,
    '{{"shot_no":' || shot_no || CASE WHEN visual IS NULL THEN '' ELSE ',"visual":' || to_json(visual) END || CASE WHEN search_query IS NULL THEN '' ELSE ',"search_query":' || to_json(search_query) END || '}}' AS j
  FROM {SHOTS}),
e AS (SELECT plan_id, sum(length(j) + 2) OVER (PARTITION BY plan_id ORDER BY shot_no, j) + 11 - 2 AS ends, sum(length(j) + 2) OVER (PARTITION BY plan_id) + 12 - 2 + 1 AS whole FROM j)
SELECT plan_id, CAST(count(*) FILTER (WHERE ends <= floor(whole * 2 / 3)) AS INTEGER) AS n_shots FROM e GROUP BY plan_id"""
_FAILS = "((instr('0123456789abcdef', md5({0})[1]) - 1) * 16 + instr('0123456789abcdef', md5({0})[2]) - 1) % 4 = 0"
ORACLE["backend_chain"] = f"""SELECT CASE WHEN {_FAILS.format('caption_text')} THEN 'echo' ELSE 'failing' END AS backend, count(*) AS n,
  CAST(sum(CASE WHEN {_FAILS.format('caption_text')} THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM {SHOTS} WHERE caption_text <> '' GROUP BY 1"""
QUERIES = {k: globals()[k] for k in (*ORACLE, "script_revision", "page_stitch", "resilient_json")}
