"""Folds over the sorted rows of each key in one streaming pass: constant state, linear time, whatever a key's size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable, finish: Callable | None = None) -> DataFrame:
    """Rows that ``step`` and ``finish`` give over each key's rows in ``order``.

    ``step(state, row)`` gives the new state (None at a key's first row) and a list of rows to put out; ``finish(state)`` those
    after a key's last row. Rows are tuples in the order of the columns; null numbers come as NaN or None. The keys' rows are
    sorted within their partition and never gathered; of Arrow batches only the state is carried on."""
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    at = [df.columns.index(k) for k in keys]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b[c].tolist() for c in b.columns), strict=True):
                k = tuple(row[i] for i in at)
                if k != key:
                    if key is not None and finish:
                        out += finish(state)
                    key, state = k, None
                state, more = step(state, row)
                out += more
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None and finish:
            yield pd.DataFrame(finish(state), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(each, schema)


def kind(df: DataFrame, column: str) -> str:
    """A column's type as a schema string."""
    return df.schema[column].dataType.simpleString()
