"""Sinks: one document a key as text or JSON, and ZIP parts. Files are written by the workers, a folder a key's hash.

Writing twice replaces: paths are derived from the key only, so a retried task leaves the same files.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def write_documents(df: DataFrame, key: str, document: str, folder: str, suffix: str = ".txt") -> DataFrame:
    """Each row's document to ``folder/<key><suffix>`` on shared storage: ``(key, path, bytes)``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for k, stem, text in zip(b["key"], b["stem"], b["text"], strict=True):
                path, data = os.path.join(folder, stem + suffix), (text or "").encode()
                with open(path + ".part", "wb") as f:
                    f.write(data)
                os.replace(path + ".part", path)
                rows.append((k, path, len(data)))
            yield pd.DataFrame(rows, columns=["key", "path", "bytes"])

    x = df.select(F.col(key).cast("string").alias("key"), T.file_stem(F.col(key).cast("string")).alias("stem"), F.col(document).alias("text"))
    return x.mapInPandas(each, "key string, path string, bytes long").withColumnRenamed("key", key)


def part_names(parts: DataFrame, key: str) -> DataFrame:
    """``(key, part_no, name)`` of each part: one part is ``key.zip``, several are ``key_part_001.zip`` and so on."""
    n = parts.groupBy(key).agg(F.max("part_no").alias("n"))
    x = parts.select(key, "part_no").distinct().join(n, key)
    return x.select(key, "part_no", F.when(F.col("n") == 1, F.concat(key, F.lit(".zip"))).otherwise(F.concat(key, F.lit("_part_"), F.format_string("%03d", "part_no"), F.lit(".zip"))).alias("name"))


def write_zip_parts(files: DataFrame, folder: str) -> DataFrame:
    """``files``: (archive, name, content). One ZIP an archive: ``(archive, path, n_files)``. An archive's size is bounded by
    the packing (``bundle_parts``), so its files fit a task."""

    def one(b: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, b["archive"].iloc[0])
        with zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(b["name"], b["content"], strict=True)):
                z.writestr(n, c)
        os.replace(path + ".part", path)
        return pd.DataFrame({"archive": b["archive"].iloc[:1], "path": path, "n_files": len(b)})

    return files.select("archive", "name", "content").groupBy("archive").applyInPandas(one, "archive string, path string, n_files int")
