"""Positional Burrows-Wheeler order of genotype vectors, and its inverse.

Within each block of rows, a vector's elements are laid out in the stable order of the vectors before it, so equal
haplotypes come to stand together. The order starts anew in each block and is kept apart for each vector length, so blocks
are independent: they are the unit of work, of at most ``block`` rows, however large a contig is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of a block at most, so that one fits a worker however long vectors are.
CELLS = 1 << 24


def _walk(vectors: list, back: bool) -> list:
    orders: dict[int, np.ndarray] = {}
    out = []
    for v in vectors:
        if v is None:
            out.append(None)
            continue
        x = np.asarray(v)
        order = orders.get(len(x), np.arange(len(x)))
        if back:
            plain = np.empty_like(x)
            plain[order] = x
            laid = x
        else:
            plain = laid = x[order]
        orders[len(x)] = order[np.argsort(laid, kind="stable")]
        out.append(plain.tolist())
    return out


def _apply(df: DataFrame, field: str, block: int, back: bool) -> DataFrame:
    longest = df.agg(F.max(F.size(field))).first()[0] or 1
    block = max(1, min(block, CELLS // max(1, longest)))
    rows = df.select("row_idx", field, F.floor(F.col("row_idx") / block).alias("__block"))
    kind = df.schema[field].dataType.simpleString()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx", kind="stable")
        return pd.DataFrame({"row_idx": pdf["row_idx"], field: pd.Series(_walk(pdf[field].tolist(), back), index=pdf.index, dtype=object)})

    return rows.groupBy("__block").applyInPandas(walk, f"row_idx bigint, {field} {kind}")


def sort(df: DataFrame, field: str = "gt", block: int = 4096) -> DataFrame:
    """(row_idx, field): the vectors in positional order. ``row_idx`` must be unique; vectors must have no null elements; null vectors stay."""
    return _apply(df, field, block, False)


def unsort(df: DataFrame, field: str = "gt", block: int = 4096) -> DataFrame:
    """The inverse of ``sort`` with the same ``block``."""
    return _apply(df, field, block, True)
