"""External kernels - language models, OCR, speech, vision, alignment - behind small interfaces.

A kernel is loaded once per worker and fed Arrow batches; what fails gives an error column and a default, never a failed
job. The stubs are pure functions of their input, so results can be told in advance and tested. Equal prompts are sent once:
they are made distinct before the kernel and joined back.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.session import cut


class TextKernel(Protocol):
    """Text to text: OCR correction, stitching, summaries, scripts, scores, keywords, plans, vowel marks."""

    def __call__(self, prompt: str) -> str: ...


def digest(text: str, n: int, mod: int) -> list[int]:
    """n numbers below mod that depend on the text only."""
    h = hashlib.md5(text.encode()).digest()
    return [h[i % 16] % mod for i in range(n)]


def echo(prompt: str) -> str:
    return prompt


def score_stub(prompt: str) -> str:
    """Five criteria out of 10 as JSON in a sentence, as models answer."""
    return "Scores: " + json.dumps(dict(zip(("hook", "structure", "pacing", "clarity", "tone"), (5 + x for x in digest(prompt, 5, 6)), strict=True)))


def vision_stub(prompt: str) -> str:
    return json.dumps(dict(zip(("subject", "quality", "cinematic"), digest(prompt, 3, 4), strict=True)))


def keyword_stub(prompt: str) -> str:
    w = prompt.split()[:6]
    return json.dumps({"wikimedia": w[:4], "pexels": w[:3], "key_phrases": w[:2]}, ensure_ascii=False)


def failing_stub(prompt: str) -> str:
    """Fails for every fourth prompt."""
    if digest(prompt, 1, 4)[0] == 0:
        raise RuntimeError("no answer")
    return prompt


#: Kernels by name; an application puts its own beside the stubs.
REGISTRY: dict[str, Callable[[], TextKernel]] = {"echo": lambda: echo, "score": lambda: score_stub, "vision": lambda: vision_stub, "keywords": lambda: keyword_stub, "failing": lambda: failing_stub}
#: Optional packages that real kernels need, and what they do.
OPTIONAL = {"kraken": "ocr", "pytesseract": "ocr", "easyocr": "ocr", "paddleocr": "ocr", "whisperx": "align", "whisper": "align", "gtts": "speech", "mishkal": "vowels", "farasa": "vowels", "fitz": "pdf"}


def available(kind: str) -> list[str]:
    """Installed packages of a kind, in the order of preference."""
    from importlib.util import find_spec

    return [p for p, k in OPTIONAL.items() if k == kind and find_spec(p) is not None]


def complete(df: DataFrame, prompt: Column, kernel: str | Callable[[], TextKernel], default: Column | None = None) -> DataFrame:
    """``df`` with ``answer`` and ``error``: each distinct prompt goes to the kernel once; failures give ``default``.

    ``kernel``: a registered name, or a function that makes a kernel (called once per task). Prompts are told apart by 128 bits
    of hash, so the join back shuffles no text but the rows' own. Answers are cut from their lineage: whatever is done with them,
    no prompt is sent twice, and what has been answered stays answered."""
    make = REGISTRY[kernel] if isinstance(kernel, str) else kernel

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = make()
        for b in batches:
            rows = []
            for h, p in zip(b["__hash"], b["prompt"], strict=True):
                try:
                    rows.append((h, k(p), None))
                except Exception as e:  # one item's failure is its own
                    rows.append((h, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["__hash", "answer", "error"])

    x = df.withColumn("__hash", F.md5(prompt))
    once = x.select("__hash", prompt.alias("prompt")).where("prompt IS NOT NULL").groupBy("__hash").agg(F.first("prompt").alias("prompt"))
    answers = cut(once.mapInPandas(each, "__hash string, answer string, error string"))
    out = x.join(answers, "__hash", "left")
    return out.withColumn("answer", F.coalesce("answer", default) if default is not None else F.col("answer")).drop("__hash")


def first_backend(df: DataFrame, prompt: Column, kernels: list[str | Callable[[], TextKernel]]) -> DataFrame:
    """``answer``, ``backend`` and ``errors`` of the first kernel that answers; only unanswered rows go on to the next.

    ``errors`` lists what the kernels before it said, in their order."""
    done, todo = [], df.withColumn("errors", F.array().cast("array<string>"))
    for i, k in enumerate(kernels):
        x = complete(todo, prompt, k)
        name = k if isinstance(k, str) else f"kernel {i + 1}"
        done.append(x.where("answer IS NOT NULL").withColumn("backend", F.lit(name)).drop("error"))
        failed = F.concat("errors", F.array(F.concat(F.lit(f"{name}: "), F.coalesce("error", F.lit("no prompt")))))
        todo = cut(x.where("answer IS NULL").withColumn("errors", failed).drop("answer", "error"))
    done.append(todo.withColumn("answer", F.lit(None).cast("string")).withColumn("backend", F.lit(None).cast("string")))
    return reduce(lambda a, b: a.unionByName(b), done)


SCORES = "hook int, structure int, pacing int, clarity int, tone int"


def scores(answer: Column) -> Column:
    """Five scores from an answer; 5 for what is missing."""
    j = F.from_json(T.json_object(answer, greedy=False), SCORES)
    return F.struct(*(F.coalesce(j[c.split()[0]], F.lit(5)).alias(c.split()[0]) for c in SCORES.split(", ")))


def vision_scores(answer: Column) -> Column:
    """Three scores from 0 to 3; the neutral ones where the kernel failed."""
    j = F.from_json(T.json_object(answer), "subject int, quality int, cinematic int")
    one = lambda c, d: F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(j[c], F.lit(d)))).alias(c)
    return F.struct(one("subject", 2), one("quality", 2), one("cinematic", 1))


def keywords(answer: Column) -> Column:
    j = F.from_json(T.strip_fence(answer), "wikimedia array<string>, pexels array<string>, key_phrases array<string>")
    cut = lambda c, n: F.slice(F.coalesce(j[c], F.array().cast("array<string>")), 1, n).alias(c)
    return F.struct(cut("wikimedia", 4), cut("pexels", 3), cut("key_phrases", 2))


def revise(books: DataFrame, write: str | Callable, judge: str | Callable, attempts: int = 3, least: int = 35, words: tuple[int, int] = (625, 850)) -> DataFrame:
    """Scripts written, scored and, if not good enough, written again with the feedback: ``(book_id, script, total, n_words, retries)``.

    Every pass works on the books that aren't done; the last attempt stands even if it is worse. ``retries`` counts failed
    attempts. ``books``: (book_id, outline)."""
    todo, done = books.select("book_id", F.col("outline").alias("prompt_text")), []
    for i in range(attempts):
        w = complete(todo, F.col("prompt_text"), write, F.lit("")).withColumnRenamed("answer", "script").drop("error")
        s = complete(w, F.col("script"), judge).withColumn("s", scores(F.col("answer")))
        s = s.withColumn("total", sum((F.col("s")[c.split()[0]] for c in SCORES.split(", ")), F.lit(0))).withColumn("n_words", T.n_words(F.col("script")))
        s = cut(s.select("book_id", "prompt_text", "script", "total", "n_words"))
        good = (F.col("total") >= least) & F.col("n_words").between(*words)
        last = F.lit(i == attempts - 1)
        cols = ["book_id", "script", "total", "n_words"]
        done.append(s.where(good | last).select(*cols, (F.lit(i) + F.when(good, 0).otherwise(1)).cast("int").alias("retries")))
        todo = s.where(~good).select("book_id", F.concat("prompt_text", F.lit("\n# attempt "), F.lit(str(i + 1))).alias("prompt_text"))
    return reduce(lambda a, b: a.unionByName(b), done)


def replace_words(c: Column, table: dict[str, str]) -> Column:
    """Words replaced by a bounded table of confusions, others kept."""
    if not table:
        return c
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(m[w], w)), " ")


def salvage(raw: str | None) -> list[dict]:
    """Shots of a plan in JSON that may have been cut off: all of it, or the objects before the cut.

    An object counts when its braces close outside strings; a backslash hides the next character even outside them."""
    if not raw:
        return []
    try:
        whole = json.loads(raw)
        return whole if isinstance(whole, list) else whole.get("shots", [])
    except ValueError:
        pass
    import re

    head = re.search(r'"shots"\s*:\s*\[', raw)
    if not head:
        return []
    out, depth, begin = [], 0, -1
    for m in re.finditer(r'\\.|"(?:\\.|[^"\\])*(?:"|$)|[{}\]]', raw[head.end() :], re.DOTALL):
        t = m.group()
        if t == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif t == "}":
            depth -= 1
            if depth == 0:
                try:
                    out.append(json.loads(raw[head.end() + begin : head.end() + m.end()]))
                except ValueError:
                    break
        elif t == "]" and depth == 0:
            break
    return out


def salvaged_plans(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with ``shots``, an array of JSON objects as text, from truncated plans."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(shots=[[json.dumps(x, ensure_ascii=False, sort_keys=True) for x in salvage(t)] for t in b[raw]])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(each, f"{fields}, shots array<string>")


def stitch_pages(pages: DataFrame, kernel: str | Callable[[str], dict]) -> DataFrame:
    """Pages joined over their boundaries, book by book in order: ``(book_id, page_no, text)``.

    The kernel sees the last two and the first three non-blank lines of neighbouring pages and tells ``join``, ``header``,
    ``footer`` and ``footnote_span``. A header is blanked on the next page, a footer on this one, from its end. Joining moves the first
    non-blank line of the next page to the end of this one, unless a footnote spans both; the next boundary sees that - a chain, so a
    book is one group. A book's pages are the bound of a group."""
    ask = (lambda p: {"join": digest(p, 1, 3)[0] == 0}) if kernel == "stub" else kernel

    def blank(lines: list[str], said: str | None, order: Callable) -> None:
        """Blank the first line, in ``order``, that holds what was said or is part of it."""
        hit = next((k for k in order(range(len(lines))) if lines[k].strip() and (said.strip() in lines[k] or lines[k].strip() in said)), None) if said else None
        if hit is not None:
            lines[hit] = ""

    def book(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("page_no")
        texts = [(t or "").splitlines() for t in b["raw_text"]]
        for here, then in zip(texts, texts[1:], strict=False):
            tail, head = [x for x in here if x.strip()][-2:], [x for x in then if x.strip()][:3]
            if not tail or not head:
                continue
            said = ask("\n".join(tail) + "\n---\n" + "\n".join(head))
            blank(then, said.get("header"), iter)
            blank(here, said.get("footer"), reversed)
            first = next((k for k, x in enumerate(then) if x.strip()), None)
            if said.get("join") and not said.get("footnote_span") and first is not None:
                here.append(then.pop(first))
        return pd.DataFrame({"book_id": b["book_id"], "page_no": b["page_no"], "text": ["\n".join(x) for x in texts]})

    return pages.select("book_id", "page_no", "raw_text").groupBy("book_id").applyInPandas(book, "book_id string, page_no int, text string")
