"""Slots for engines that read images, speak, align or plan: one loop with errors kept per item, and what comes after each.

An engine is a function of one item, made once a task; the stubs are pure functions of their input. An item that fails gives its
error beside empty values, never a failed job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

from .kernels import digest, salvage

WORDS = "array<struct<block:int,par:int,line:int,word:string,conf:double>>"


def run_slot(df: DataFrame, inputs: list[str], make: Callable[[], Callable], kind: str) -> DataFrame:
    """``df`` with ``value`` (of type ``kind``) and ``error``: the engine's answer to the ``inputs`` of each row.

    A null first input isn't given to the engine: its value and error are null."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for b in batches:
            values: list = []
            errors: list = []
            for row in zip(*(b[c] for c in inputs), strict=True):
                value = error = None
                if row[0] is not None:
                    try:
                        value = engine(*row)
                    except Exception as e:  # one item's failure is its own
                        error = f"{type(e).__name__}: {e}"
                values.append(value)
                errors.append(error)
            yield b.assign(value=pd.Series(values, index=b.index, dtype=object), error=pd.Series(errors, index=b.index, dtype=object))

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(each, f"{fields}, value {kind}, error string")


def line_text(words: Column, least: float) -> Column:
    """Recognised words of at least ``least`` confidence as lines: words of a line by a blank, lines by a line end, in order."""
    kept = F.filter(words, lambda w: (w["conf"] >= least) & (T.strip(w["word"]) != ""))
    at = lambda w: F.struct(w["block"], w["par"], w["line"])
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("struct<block:int,par:int,line:int>").alias("at"))

    def step(a: Column, w: Column) -> Column:
        here = at(w)
        glue = F.when(a["at"].isNull(), "").when(a["at"] == here, " ").otherwise("\n")
        return F.struct(F.concat(a["text"], glue, w["word"]).alias("text"), here.alias("at"))

    return F.aggregate(kept, start, step, lambda a: a["text"])


def two_pass(pages: DataFrame, image: str, head: Callable, body: Callable, least: float = 65.0) -> DataFrame:
    """A page read twice: the strip at its head with a threshold of confidence, the rest as it is; ``text``, ``error``."""
    x = run_slot(pages, [image], head, WORDS).withColumn("head", line_text(F.col("value"), least)).withColumnRenamed("error", "head_error").drop("value")
    x = run_slot(x, [image], body, "string")
    text = F.when(F.coalesce("head", F.lit("")) != "", F.concat_ws("\n", "head", "value")).otherwise(F.col("value"))
    return x.withColumn("text", text).withColumn("error", F.coalesce("error", "head_error")).drop("value", "head", "head_error")


def words_stub(lines: int | None = None) -> Callable[[], Callable]:
    """Reads bytes as text: each word with a confidence told from its letters."""

    def read(image: bytes) -> list[dict]:
        rows = image.decode().split("\n")[:lines]
        return [{"block": 1, "par": 1, "line": i, "word": w, "conf": float(len(w) * 13 % 100)} for i, x in enumerate(rows, 1) for w in x.split()]

    return lambda: read


def body_stub() -> Callable:
    return lambda image: "\n".join(image.decode().split("\n")[1:])


def confident_lines(pages: DataFrame, image: str, engine: Callable, least: float = 0.3) -> DataFrame:
    """Lines that an engine is sure enough of, joined by line ends: ``text``, ``error``."""
    x = run_slot(pages, [image], engine, "array<struct<line:string,conf:double>>")
    return x.withColumn("text", F.array_join(F.transform(F.filter("value", lambda v: v["conf"] >= least), lambda v: v["line"]), "\n")).drop("value")


def lines_stub() -> Callable:
    return lambda image: [{"line": x, "conf": len(x) % 10 / 10} for x in image.decode().split("\n")]


def speech(texts: DataFrame, text: str, engine: Callable) -> DataFrame:
    """Sound of each text as bytes; a blank text is an error."""

    def make() -> Callable:
        say = engine()

        def one(t: str) -> bytes:
            if not t.strip():
                raise ValueError("nothing to say")
            return say(t)

        return one

    return run_slot(texts, [text], make, "binary")


def speech_stub() -> Callable:
    return lambda t: b"ID3" + t.encode()


def vowelled(texts: DataFrame, key: str, text: str, engine: Callable, size: int = 500) -> DataFrame:
    """Texts with vowel marks, sentence group by sentence group joined by blanks: ``(key, text, failed)``; a group whose engine
    fails stays as it is."""
    parts = texts.select(key, F.posexplode(T.sentence_chunks(F.col(text), size)).alias("i", "part"))
    x = run_slot(parts, ["part"], engine, "string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("value", "part").alias("v")))), lambda r: r["v"]), " ")
    return x.groupBy(key).agg(joined.alias("text"), F.count("error").alias("failed"))


def vowel_stub() -> Callable:
    def one(t: str) -> str:
        if "?" in t:
            raise RuntimeError("no model for this")
        return t.replace("ا", "اَ")

    return one


def aligned(recordings: DataFrame, words: str, audio: str, engine: Callable) -> DataFrame:
    """Words of a script with their times in a recording: the columns beside ``words`` and ``audio``, ``ord``, ``word``, ``start``,
    ``end``; recordings that can't be aligned give none."""
    x = run_slot(recordings, [words, audio], engine, "array<struct<word:string,start:double,end:double>>")
    keep = [c for c in recordings.columns if c not in (words, audio)]
    return x.select(*keep, F.posexplode("value").alias("ord", "w")).select(*keep, "ord", "w.word", "w.start", "w.end")


def align_stub() -> Callable:
    return lambda words, audio: [{"word": w, "start": i * 0.5, "end": i * 0.5 + 0.4} for i, w in enumerate(words)]


def planned(books: DataFrame, engine: Callable, n: str = "n_shots") -> DataFrame:
    """Shot plans: one prompt a book, the answer's whole shots even where it was cut: ``(book_id, shot_no, start, end, visual)``."""

    def make() -> Callable:
        ask = engine()
        return lambda prompt, k: [json.dumps(x, ensure_ascii=False) for x in salvage(ask(prompt, k))]

    x = run_slot(books, ["prompt", n], make, "array<string>").select("book_id", F.posexplode("value").alias("i", "j"))
    s = F.from_json("j", "start double, `end` double, visual string")
    return x.select("book_id", (F.col("i") + 1).alias("shot_no"), F.coalesce(s["start"], F.lit(0.0)).alias("start"), F.coalesce(s["end"], F.lit(0.0)).alias("end"), F.coalesce(s["visual"], F.lit("archive")).alias("visual"))


def plan_stub() -> Callable:
    """So many shots of five seconds; the last one is cut off."""

    def one(prompt: str, n: int) -> str:
        whole = json.dumps({"shots": [{"start": 5.0 * i, "end": 5.0 * i + 5.0, "visual": "map" if i % 2 else "archive"} for i in range(n)]})
        return whole[:-4]

    return one


def says_yes(answer: Column) -> Column:
    """Whether an answer begins with yes; null for null."""
    return F.lower(T.strip(answer)).startswith("yes")


def yes_no_stub() -> Callable:
    return lambda prompt: "Yes, it fits." if digest(prompt, 1, 2)[0] else "NO."
