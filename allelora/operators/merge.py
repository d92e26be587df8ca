"""Merging files by site, groups of variants, and splitting of alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SITE = ["chrom", "pos", "ref", "alt"]


def split_alternatives(df: DataFrame) -> DataFrame:
    """One row per alternative: ``alt``, ``alt_idx`` from 1 and gt with 1 where it has that allele, 0 for others; missing
    and end-of-vector elements stay. Sites without alternatives have no row."""
    rows = df.select("*", F.posexplode("alts").alias("__i", "alt")).withColumn("alt_idx", F.col("__i") + 1)
    own = F.transform("gt", lambda x: F.when(x < 0, x).otherwise((x == F.col("alt_idx")).cast("int")))
    return rows.withColumn("gt", own).drop("__i", "alts")


def merge_sites(a: DataFrame, b: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Full outer merge of two files by (chrom, pos, ref, alt): gt vectors side by side.

    ``n_a`` and ``n_b`` are the lengths of the files' vectors; a file without the site gives zeros. Null keys match nothing
    and stay on their own. A site that a file has several times meets each of the other file's.
    """
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    x, y = a.select(*SITE, F.col("gt").alias("gt_a")), b.select(*SITE, F.col("gt").alias("gt_b"))
    return x.join(y, SITE, "full").select(*SITE, F.concat(F.coalesce("gt_a", zeros(n_a)), F.coalesce("gt_b", zeros(n_b))).alias("gt"))


def merge_files(files: list[DataFrame], slots: list[int], mode: str = "compat") -> DataFrame:
    """k files merged by (chrom, pos, ref, alts): rows (chrom, pos, ref, alts, info, gt), gt vectors side by side in the files' order.

    Each file has row_idx, chrom, pos, ref, alts, info and gt, vectors of ``slots`` elements; a file without the site, or with a null vector, gives
    zeros. Of an info key in several files the last file's value counts; AC, AN, AF and MAF are recomputed by ``mode``. A site that a file has several
    times meets the other files' by its number among them. Null keys are equal to each other. One shuffle for all files, whatever their number.
    """
    from allelora.operators.stats import update_info

    keys = ["chrom", "pos", "ref", "alts"]
    rows = None
    for i, one in enumerate(files):
        nth = F.row_number().over(W.partitionBy(*keys).orderBy("row_idx")) if "row_idx" in one.columns else F.lit(1)
        part = one.select(*keys, nth.alias("__nth"), F.struct(F.lit(i).alias("file"), "gt", "info").alias("__own"))
        rows = part if rows is None else rows.unionByName(part)
    # A group has at most one row of each file.
    merged = rows.groupBy(*keys, "__nth").agg(F.collect_list("__own").alias("__files"))
    own = lambda i: F.get(F.filter("__files", lambda f: f["file"] == i), F.lit(0))
    none = F.create_map().cast("map<string,string>")
    info = none
    for i in range(len(files)):
        info = _overwritten(info, F.coalesce(own(i)["info"], none))
    sites = merged.select(*keys, info.alias("info"), F.concat(*(F.coalesce(own(i)["gt"], F.array_repeat(F.lit(0), n)) for i, n in enumerate(slots))).alias("gt"))
    return update_info(sites, ("AC", "AN", "AF", "MAF"), mode)


def _overwritten(old: Column, new: Column) -> Column:
    """Entries of both maps, those of ``new`` where a key is in both."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def group_members(groups: DataFrame) -> DataFrame:
    """(group, chrom, pos, ref, alt) of lines ``group<tab>CHROM:POS_REF/ALT<tab>...``; ids that don't parse are left out."""
    cells = F.split("line", "\t")
    rows = groups.select(F.get(cells, F.lit(0)).alias("group"), F.explode(F.slice(cells, F.lit(2), F.size(cells))).alias("id"))
    part = lambda i: F.regexp_extract("id", r"\A([^:]+):([0-9]+)_([^/]*)/(.*)\z", i)
    return rows.where(part(1) != "").select("group", part(1).alias("chrom"), part(2).try_cast("int").alias("pos"), part(3).alias("ref"), part(4).alias("alt")).distinct()


def group_sites(df: DataFrame, members: DataFrame) -> DataFrame:
    """Sites of each group: those of which any alternative is a member. (group, all columns of ``df``), once per group."""
    hit = members.groupBy("group", "chrom", "pos", "ref").agg(F.collect_set("alt").alias("__alts"))
    return df.join(hit, ["chrom", "pos", "ref"]).where(F.arrays_overlap("alts", "__alts")).select("group", *df.columns)


def burden(sites: DataFrame, dosage: Column, group: str = "group") -> DataFrame:
    """(group, sample_idx, burden): the sum over a group's sites of each sample's dosage, summed before the shuffle."""
    rows = sites.select(group, F.posexplode(dosage).alias("sample_idx", "ds"))
    return rows.groupBy(group, "sample_idx").agg(F.sum("ds").alias("burden"))


def group_matrix(sites: DataFrame, dosage: Column, group: str = "group", rows: int = 100) -> DataFrame:
    """(group, block, matrix): per group its sites' dosages in blocks of ``rows`` rows, so no matrix grows with the data."""
    from allelora.operators.skew import running

    placed = running(sites.select(group, "row_idx", dosage.alias("ds")), group, ["row_idx"])
    return placed.groupBy(group, F.floor(F.col("rank") / rows).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ds"))), lambda x: x["ds"]).alias("matrix"))
