"""Sorting, concatenation and sample order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.functions.batches import allele_blocks
from allelora.session import cut


def sort_key(point: str) -> Column:
    """Position by which a site is sorted: its begin, middle or end, by its longest allele."""
    longest = F.greatest(F.length("ref"), F.coalesce(F.array_max(F.transform("alts", lambda a: F.length(a))), F.lit(0)))
    return {"beg": F.col("pos").cast("double"), "mid": F.col("pos") + longest / 2.0, "end": (F.col("pos") + longest).cast("double")}[point]


def order_columns(point: str = "beg", descending: bool = False, tie: str = "row_idx") -> list[Column]:
    """Contigs of the header in its order, then others by name; then the key; ties by ``tie``. Descending is the exact reverse."""
    cols = [F.coalesce(F.col("ord"), F.lit(2**31 - 1)), F.col("chrom"), sort_key(point), F.col(tie)]
    return [c.desc() if descending else c.asc() for c in cols]


def sort_sites(df: DataFrame, contigs: DataFrame, point: str = "beg", descending: bool = False) -> DataFrame:
    """Sites in total order: a range partitioning and a sort in each partition."""
    return _ordered(df, contigs).orderBy(*order_columns(point, descending)).drop("ord")


def _ordered(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """With contig order; contigs are header lines, joined by broadcast where Spark finds them small."""
    return df.join(contigs.groupBy("chrom").agg(F.min("ord").alias("ord")), "chrom", "left")


def ranked(df: DataFrame, contigs: DataFrame, point: str = "beg", descending: bool = False) -> DataFrame:
    """``df`` with ``rank`` from 1 in the sort's order. Ranks are numbered per range partition and stitched, not in one task."""
    return numbered(_ordered(df, contigs), order_columns(point, descending)).withColumn("rank", F.col("rank") + 1).drop("ord")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``rank`` from 0 in ``order``: a total sort, counts per partition, and a running sum over the counts."""
    placed = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1], r[2]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)), F.min("__id")).collect())
    offsets, total = [], 0
    for part, n, first in counts:
        offsets.append((part, total - first))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__part int, __offset bigint")
    return placed.join(F.broadcast(table), "__part").withColumn("rank", F.col("__id") + F.col("__offset")).drop("__part", "__id", "__offset")


def concat(parts: list[DataFrame], samples: list[int] | None = None) -> DataFrame:
    """All rows of ``parts`` in argument order, with ``file_ord`` and a new contiguous ``row_idx``.

    Every part must have contiguous ``row_idx`` from 0 and the columns of the first. ``samples`` are the files'
    numbers of samples, which must be equal.
    """
    if samples is not None and len(set(samples)) > 1:
        raise ValueError("files have different numbers of samples")
    out, before = None, 0
    for i, part in enumerate(parts):
        if {c.lower() for c in part.columns} != {c.lower() for c in parts[0].columns}:
            raise ValueError("files have different columns")
        moved = part.withColumn("row_idx", F.col("row_idx") + before).withColumn("file_ord", F.lit(i))
        out = moved if out is None else out.unionByName(moved)
        before += part.count()
    return out


def sample_order(df: DataFrame, n_samples: int) -> list[int]:
    """Sample indices by number of non-reference alleles, most first, then by index.

    Vectors have length div n_samples elements a sample; null and shorter ones are passed over. Each task sends one row per
    sample, and one row per sample is collected.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_samples, np.int64)
        for batch in batches:
            for block in allele_blocks(batch.column(0), n_samples):
                total += (block > 0).sum(axis=(0, 2))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_samples, dtype=np.int32)), pa.array(total)], names=["s", "n"])

    counts = df.select("gt").mapInArrow(scan, "s int, n bigint").groupBy("s").agg(F.sum("n").alias("n"))
    return [r["s"] for r in counts.orderBy(F.desc("n"), "s").collect()]
