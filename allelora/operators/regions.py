"""Selection by genomic region, by slice, and operations on regions.

Positions are 1-based, region ends inclusive; slices are 0-based, their ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAST = 2**63 - 1


@dataclass(frozen=True)
class Region:
    """A stretch of a contig; an empty chrom stands for all contigs."""

    chrom: str = ""
    start: int = 0
    end: int = LAST

    @classmethod
    def parse(cls, text: str) -> "Region":
        """``chr``, ``chr:p``, ``chr:b-`` or ``chr:b-e``."""
        m = re.fullmatch(r"([^:]*)(?::(\d+)(?:(-)(\d*))?)?", text)
        if not m:
            raise ValueError(f"not a region: {text!r}")
        chrom, start, dash, end = m.groups()
        if start is None:
            return cls(chrom)
        return cls(chrom, int(start), int(end) if end else LAST if dash else int(start))


def end_pos(info: Column | None = None) -> Column:
    """Last position of a site: END of its info if that is a number, else by its longest allele."""
    longest = F.greatest(F.length("ref"), F.coalesce(F.array_max(F.transform("alts", lambda a: F.length(a))), F.lit(0)))
    by_length = F.col("pos").cast("bigint") + longest - 1
    return by_length if info is None else F.coalesce(info["END"].try_cast("bigint"), by_length)


def matches(start: Column, end: Column, how: str, last: Column | None = None) -> Column:
    """Whether a site meets [start, end]: by its begin, any overlap, all of it, or its end.

    ``last`` is the site's last position. Conditions on ``pos`` that follow from the others are spelled out where they
    can be pushed into the scan.
    """
    pos = F.col("pos")
    last = end_pos() if last is None else last
    if how == "beg":
        return pos.between(start, end)
    if how == "any":
        return (pos <= end) & (last >= start)
    if how == "all":
        return (pos >= start) & (pos <= end) & (last <= end)
    if how == "end":
        return (pos <= end) & last.between(start, end)
    raise ValueError(f"no such bounding point: {how}")


def in_region(df: DataFrame, region: Region, how: str = "beg", last: Column | None = None) -> DataFrame:
    """Sites of one region. The conditions on chrom and pos reach the scan."""
    cond = matches(F.lit(min(region.start, LAST)), F.lit(min(region.end, LAST)), how, last)
    return df.where(cond if not region.chrom else (F.col("chrom") == region.chrom) & cond)


def in_regions(df: DataFrame, regions: list[Region], how: str = "beg", last: Column | None = None) -> DataFrame:
    """Sites of several regions, with ``region_ord``: once for each region that a site meets, regions aren't merged.

    Order by (region_ord, row_idx) for the order of one scan per region. Each region is one branch of an inline
    list per row, so the scan isn't repeated and nothing is shuffled; the list has as many entries as the caller gave.
    """
    hits = F.array(*(F.when(((F.lit(r.chrom) == "") | (F.col("chrom") == r.chrom)) & matches(F.lit(r.start), F.lit(r.end), how, last), F.lit(i)) for i, r in enumerate(regions)))
    if not regions:
        return df.withColumn("region_ord", F.lit(0)).where("false")
    chroms = sorted({r.chrom for r in regions})
    pruned = df if "" in chroms else df.where(F.col("chrom").isin(chroms))
    return pruned.withColumn("region_ord", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(region_ord, chrom, start, end) of lines ``chrom<tab>start<tab>end``, both ends inclusive and from 1; region_ord follows the lines."""
    cells = F.split(F.regexp_replace("value", r"\r\z", ""), "\t")
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("region_ord"), cells.alias("c")).where(F.size("c") >= 3)
    return rows.select("region_ord", F.get("c", F.lit(0)).alias("chrom"), F.get("c", F.lit(1)).cast("bigint").alias("start"), F.get("c", F.lit(2)).cast("bigint").alias("end"))


def join_regions(df: DataFrame, regions: DataFrame, how: str = "beg", last: Column | None = None, bin_size: int = 1 << 16) -> DataFrame:
    """Sites joined with a table of regions (region_ord, chrom, start, end) of any size, by any bounding point.

    Both sides meet in bins of positions, so a contig that holds most sites is spread over many keys; a region longer than
    ``bin_size`` is laid out in its bins, for ``any`` a site too, and the exact condition follows. Regions with an open end are cut at the
    contig's last position. Null contigs and positions meet nothing.
    """
    last = (F.col("pos").cast("bigint") if how == "beg" else end_pos()) if last is None else last
    bin_of = lambda c: F.floor(c / bin_size)
    sites = df.withColumn("__last", last)
    span = sites.groupBy("chrom").agg(F.max(F.greatest(F.col("pos").cast("bigint"), F.col("__last"))).alias("__top"))
    r = regions.select("*").join(span, "chrom").withColumn("__to", F.least("end", "__top")).where("start <= __to")
    binned = r.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("__to"))))).drop("__top", "__to")
    place = {"beg": F.array(bin_of(F.col("pos"))), "all": F.array(bin_of(F.col("pos"))), "end": F.array(bin_of(F.col("__last")))}
    place["any"] = F.sequence(bin_of(F.col("pos")), F.greatest(bin_of(F.col("pos")), bin_of(F.col("__last"))))
    if how not in place:
        raise ValueError(f"no such bounding point: {how}")
    laid = sites.where("pos IS NOT NULL AND __last IS NOT NULL").withColumn("__bin", F.explode(place[how]))
    met = laid.join(binned, ["chrom", "__bin"]).where(matches(F.col("start"), F.col("end"), how, F.col("__last")))
    if how == "any":
        # An overlap shows in each bin that both are in: the first of them counts.
        met = met.where(F.col("__bin") == F.greatest(bin_of(F.col("pos")), bin_of(F.col("start"))))
    return met.drop("__bin", "__last", "start", "end")


def envelope(regions: DataFrame) -> DataFrame:
    """One region per contig from the least start to the greatest end; not a union of intervals."""
    return regions.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def merge_adjacent(regions: DataFrame, order: str = "region_ord") -> DataFrame:
    """Envelopes of runs of regions of one contig that follow each other in ``order``.

    The list of regions is a query's argument, so one ordered pass over it is small.
    """
    w = W.orderBy(order)
    new = F.when(F.lag("chrom").over(w).eqNullSafe(F.col("chrom")), 0).otherwise(1)
    runs = regions.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("run", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def slice_rows(df: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows [begin, end) by ``row_idx``, which are contiguous from 0; the condition reaches the scan."""
    return df.where((F.col("row_idx") >= begin) & (F.col("row_idx") < end))


def chromosomes(df: DataFrame) -> DataFrame:
    """Contigs that occur, with the first row of each."""
    return df.groupBy("chrom").agg(F.min("row_idx").alias("first_row"))
