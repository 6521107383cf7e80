"""Queries of the engine slots with their stubs, and of whole dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators import candidates as C
from quire.operators import slots as S
from quire.session import table as t

from .sqlkit import PAGES, SHOTS, WS, words


def _images(s, d):
    """Pages as images whose bytes are their text."""
    return tables.pages(s, d).where("pdf_type = 'scanned'").select("book_id", "page_no", F.encode("raw_text", "utf-8").alias("image"))


def ocr_two_pass(s, d):
    return S.two_pass(_images(s, d), "image", S.words_stub(1), S.body_stub).select("book_id", "page_no", "text", F.col("error").isNotNull().alias("failed"))


def ocr_confident_lines(s, d):
    return S.confident_lines(_images(s, d), "image", S.lines_stub).select("book_id", "page_no", "text")


def speech_bytes(s, d):
    x = S.speech(t(s, d, "documents").select("doc_id", "text"), "text", S.speech_stub)
    return x.select("doc_id", F.octet_length("value").alias("n_bytes"), F.col("error").isNotNull().alias("failed"))


def vowel_marks(s, d):
    return S.vowelled(t(s, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text", S.vowel_stub)


def aligned_words(s, d):
    x = tables.shots(s, d).where("caption_text <> ''").select("plan_id", "shot_no", T.word_list(F.col("caption_text")).alias("words"), F.lit(b"").alias("audio"))
    return S.aligned(x, "words", "audio", S.align_stub)


def planned_shots(s, d):
    b = tables.chunks(s, d).where("text IS NOT NULL").groupBy("book_id").agg(F.count("*").cast("int").alias("n_shots")).select("book_id", F.concat(F.lit("Plan "), "book_id").alias("prompt"), "n_shots")
    return S.planned(b, S.plan_stub)


def vision_yes_no(s, d):
    x = tables.shots(s, d).where("search_query <> ''").select("plan_id", "shot_no", "search_query")
    return S.run_slot(x, ["search_query"], S.yes_no_stub, "string").select("plan_id", "shot_no", S.says_yes(F.col("value")).alias("fits"))


def whole_dossiers(s, d):
    """Dossiers with decisions, written as JSON and read again."""
    shots = tables.shots(s, d).where("plan_id IS NOT NULL AND shot_no IS NOT NULL").select("plan_id", "shot_no", "visual", F.col("search_query").alias("query"), F.greatest(F.lit(0.0), F.col("end") - F.col("start")).alias("duration_sec"), F.col("caption_text").alias("arabic_caption_excerpt"),
        F.when(F.col("shot_no") % 4 == 0, F.concat(F.lit("o"), "shot_no")).alias("override"), F.when(F.col("shot_no") % 3 == 0, F.concat(F.lit("loc:"), "shot_no")).alias("chosen"))
    cand = shots.where("shot_no % 3 = 0").select("plan_id", "shot_no", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), F.lit("loc").alias("source"), F.lit("T").alias("title"), F.concat(F.lit("u"), "shot_no").alias("url"), F.lit(7).alias("score"))
    x = C.read_decisions(C.decisions_json(shots, cand, shots.select("plan_id").distinct().withColumn("pinned_portrait", F.concat(F.lit("p/"), "plan_id"))))
    return x.select("plan_id", "shot_no", "visual", "query", F.round("duration_sec", 6).alias("duration_sec"), "arabic_caption_excerpt", "override", "chosen", "pinned_portrait", F.size("candidates").alias("n_candidates"), F.coalesce(F.try_element_at("candidates", F.lit(1))["score"], F.lit(-1)).alias("first_score"))


_IMG = f"img AS (SELECT book_id, page_no, raw_text FROM {PAGES} WHERE pdf_type = 'scanned')"
_HEAD = f"list_filter({words('string_split(raw_text, chr(10))[1]')}, lambda w: length(w) * 13 % 100 >= 65)"
_MD = "((instr('0123456789abcdef', md5(search_query)[2]) - 1) % 2 = 1)"
ORACLE = {
    "ocr_two_pass": f"""WITH {_IMG}, h AS (SELECT *, array_to_string({_HEAD}, ' ') AS head, array_to_string(string_split(raw_text, chr(10))[2:], chr(10)) AS body FROM img)
SELECT book_id, page_no, CASE WHEN raw_text IS NULL THEN NULL WHEN coalesce(head, '') <> '' THEN head || chr(10) || coalesce(body, '') ELSE coalesce(body, '') END AS text, false AS failed FROM h""",
    "ocr_confident_lines": f"WITH {_IMG} SELECT book_id, page_no, CASE WHEN raw_text IS NOT NULL THEN coalesce(array_to_string(list_filter(string_split(raw_text, chr(10)), lambda x: length(x) % 10 >= 3), chr(10)), '') END AS text FROM img",
    "speech_bytes": f"SELECT doc_id, CASE WHEN regexp_replace(text, '{WS}+', '', 'g') <> '' THEN CAST(strlen(text) + 3 AS INTEGER) END AS n_bytes, coalesce(regexp_replace(text, '{WS}+', '', 'g') = '', false) AS failed FROM documents",
    "aligned_words": f"""WITH w AS (SELECT plan_id, shot_no, {words('caption_text')} AS w FROM {SHOTS} WHERE caption_text <> ''),
u AS (SELECT plan_id, shot_no, unnest(range(0, len(w))) AS k, w FROM w) SELECT plan_id, shot_no, CAST(k AS INTEGER) AS ord, w[k + 1] AS word, k * 0.5::DOUBLE AS start, k * 0.5::DOUBLE + 0.4::DOUBLE AS "end" FROM u""",
    "planned_shots": """WITH n AS (SELECT book_id, count(*) AS n FROM (SELECT DISTINCT book_id, chunk_id, chapter, page_start, page_end, word_count, token_est, text FROM chunk) WHERE text IS NOT NULL GROUP BY book_id),
u AS (SELECT book_id, unnest(range(0, n - 1)) AS i FROM n) SELECT book_id, CAST(i + 1 AS INTEGER) AS shot_no, i * 5.0::DOUBLE AS start, i * 5.0::DOUBLE + 5 AS "end", CASE WHEN i % 2 = 1 THEN 'map' ELSE 'archive' END AS visual FROM u""",
    "vision_yes_no": f"SELECT plan_id, shot_no, {_MD} AS fits FROM {SHOTS} WHERE search_query <> ''",
    "whole_dossiers": f"""SELECT plan_id, shot_no, coalesce(visual, '') AS visual, coalesce(search_query, '') AS query, coalesce(round(greatest(0.0, "end" - start), 6), 0.0) AS duration_sec, coalesce(caption_text, '') AS arabic_caption_excerpt,
  CASE WHEN shot_no % 4 = 0 THEN 'o' || shot_no END AS override, CASE WHEN shot_no % 3 = 0 THEN 'loc:' || shot_no ELSE '' END AS chosen, 'p/' || plan_id AS pinned_portrait, CASE WHEN shot_no % 3 = 0 THEN 2 ELSE 0 END AS n_candidates,
  CASE WHEN shot_no % 3 = 0 THEN 7 ELSE -1 END AS first_score FROM {SHOTS} WHERE plan_id IS NOT NULL AND shot_no IS NOT NULL""",
}
QUERIES = {k: globals()[k] for k in (*ORACLE, "vowel_marks")}
