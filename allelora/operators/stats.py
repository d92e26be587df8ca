"""Allele statistics and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.functions.arrays import allele_counts, to_sparse
from allelora.functions.batches import dosage_blocks
from allelora.functions.text import g6
from allelora.operators.regions import end_pos

#: Effects that change the protein, and those that don't (fixed values: labels of the annotation format, in natural order).
NONSYNONYMOUS = ("frameshift", "inframe_deletion", "inframe_insertion", "missense", "start_lost", "stop_gained", "stop_lost")
SYNONYMOUS = ("start_retained", "stop_retained", "synonymous")


def with_allele_stats(df: DataFrame, mode: str = "strict", sparse_threshold: float = 1.0) -> DataFrame:
    """``df`` with ac, an, af, mac and maf of its gt vectors.

    ``strict`` counts exact alleles and leaves missing and end-of-vector elements out of an. ``compat`` takes the whole
    length as an and, for sites of one alternative whose vector is stored sparse (share of non-zeros at most
    ``sparse_threshold``), all non-zero elements as ac. mac is the least ac of the alternatives, the reference is not
    considered; sites without alternatives have empty ac and null mac. Null gt gives nulls.
    """
    exact = allele_counts(F.col("gt"), F.col("alts"))
    if mode == "strict":
        ac, an = exact, F.size(F.filter("gt", lambda x: x >= 0))
    elif mode == "compat":
        nonzero = F.size(to_sparse(F.col("gt"))["offsets"])
        sparse = F.try_divide(nonzero, F.size("gt")) <= sparse_threshold
        ac, an = F.when((F.size("alts") == 1) & sparse, F.array(nonzero)).otherwise(exact), F.size("gt")
    else:
        raise ValueError(f"no such mode: {mode}")
    known = F.col("gt").isNotNull()
    out = df.withColumn("ac", F.when(known, ac)).withColumn("an", F.when(known, an))
    out = out.withColumn("af", F.transform("ac", lambda c: F.try_divide(c.cast("double"), F.col("an"))))
    out = out.withColumn("mac", F.array_min("ac"))
    return out.withColumn("maf", F.try_divide(F.col("mac").cast("double"), F.col("an")))


def update_info(df: DataFrame, generate: tuple[str, ...] = (), mode: str = "compat") -> DataFrame:
    """Statistics written back into info as text: those a site has already, and those in ``generate``."""
    stats = with_allele_stats(df, mode)
    text = {
        "AC": F.array_join(F.transform("ac", lambda c: c.cast("string")), ","),
        "AN": F.col("an").cast("string"),
        "AF": F.array_join(F.transform("af", lambda c: g6(c.cast("float"))), ","),
        "MAC": F.col("mac").cast("string"),
        "MAF": g6(F.col("maf").cast("float")),
    }
    info = F.col("info")
    old = F.coalesce(info, F.create_map().cast("map<string,string>"))

    def wanted(key: str) -> Column:
        here = F.lit(True) if key in generate else F.coalesce(F.map_contains_key(info, F.lit(key)), F.lit(False))
        return here & text[key].isNotNull() & (text[key] != "")

    new = F.filter(F.array(*(F.when(wanted(k), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in text.items())), lambda e: e.isNotNull())
    names = F.transform(new, lambda e: e["key"])
    rest = F.filter(F.map_entries(old), lambda e: ~F.array_contains(names, e["key"]))
    return stats.withColumn("info", F.when(F.size(new) > 0, F.map_from_entries(F.concat(rest, new))).otherwise(info)).select(*df.columns)


def is_snp() -> Column:
    return F.coalesce((F.length("ref") == 1) & (F.length(F.get("alts", F.lit(0))) == 1), F.lit(False))


def effect_class(ann: Column) -> Column:
    """``nonsyn`` if any transcript's effects change the protein, else ``syn`` if any is silent, else null."""
    effects = F.flatten(F.transform(F.split(ann, ","), lambda t: F.coalesce(F.split(F.get(F.split(t, r"\|"), F.lit(1)), "&"), F.array().cast("array<string>"))))
    some = lambda names: F.coalesce(F.arrays_overlap(effects, F.array(*map(F.lit, names))), F.lit(False))
    return F.when(some(NONSYNONYMOUS), "nonsyn").when(some(SYNONYMOUS), "syn")


def summary(df: DataFrame) -> DataFrame:
    """n_records, n_variants (alternatives, at least one a record) and n_multi."""
    n_alt = F.coalesce(F.size("alts"), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.coalesce(F.sum(F.greatest(n_alt, F.lit(1))), F.lit(0)).cast("bigint").alias("n_variants"),
        F.count_if(n_alt > 1).alias("n_multi"),
    )


def _classes(ann: str) -> dict[str, Column]:
    effect = effect_class(F.col("info")[ann])
    return {"snp": is_snp(), "indel": ~is_snp(), "syn": F.coalesce(effect == "syn", F.lit(False)), "nonsyn": F.coalesce(effect == "nonsyn", F.lit(False))}


def per_sample(df: DataFrame, n_samples: int, ann: str = "ANN") -> DataFrame:
    """(sample_idx, n_het, n_hom, n_snp, n_indel, n_syn, n_nonsyn).

    g is a sample's sum of alleles, end-of-vector elements left out; samples with a missing allele are skipped; n_snp and so
    on add g; n_het counts g = 1, n_hom g > 1. Each task sums its rows as matrices and sends one row per sample.
    """
    names = ("n_het", "n_hom", "n_snp", "n_indel", "n_syn", "n_nonsyn")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_samples, len(names)), np.int64)
        for batch in batches:
            flags = np.column_stack([np.asarray(batch.column(i), dtype=bool) for i in range(1, 5)]) if batch.num_rows else None
            for rows, ds in dosage_blocks(batch.column(0), n_samples):
                g = np.where(np.isnan(ds), 0, ds).astype(np.int64)
                total += np.column_stack([(g == 1).sum(axis=0), (g > 1).sum(axis=0), g.T @ flags[rows].astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_samples, dtype=np.int32)), *(pa.array(c) for c in total.T.copy())], names=["sample_idx", *names])

    sums = df.select("gt", *(c.alias(k) for k, c in _classes(ann).items())).mapInArrow(scan, "sample_idx int, " + ", ".join(f"{k} bigint" for k in names))
    counted = sums.groupBy("sample_idx").agg(*(F.sum(k).alias(k) for k in names))
    all_samples = df.sparkSession.range(n_samples).select(F.col("id").cast("int").alias("sample_idx"))
    return all_samples.join(F.broadcast(counted), "sample_idx", "left").na.fill(0)


def per_allele_count(df: DataFrame, ann: str = "ANN") -> DataFrame:
    """(ac, n_snp, n_indel, n_syn, n_nonsyn) for every ac from 0 to the greatest an, by info's AC (its first) and AN.

    Records without a whole AC and AN, or with AC outside 0..AN, are left out.
    """
    ac, an = F.substring_index(F.col("info")["AC"], ",", 1).try_cast("int"), F.col("info")["AN"].try_cast("int")
    rows = df.select(ac.alias("ac"), an.alias("an"), *(c.alias(k) for k, c in _classes(ann).items())).where("ac BETWEEN 0 AND an")
    counts = rows.groupBy("ac").agg(*(F.count_if(F.col(k)).alias(f"n_{k}") for k in ("snp", "indel", "syn", "nonsyn")))
    bins = rows.agg(F.max("an").alias("top")).where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("ac"))
    return bins.join(counts, "ac", "left").na.fill(0)


def block_index(df: DataFrame, block: int = 4096) -> DataFrame:
    """One row per contig and block of ``block`` rows of the file: least pos, greatest last position, records."""
    return df.groupBy("chrom", F.floor(F.col("row_idx") / block).alias("block_id")).agg(
        F.min("pos").alias("min_pos"), F.max(end_pos()).alias("max_end"), F.count(F.lit(1)).alias("n")
    )


def index_summary(df: DataFrame, block: int = 4096) -> DataFrame:
    """Per contig: blocks, records, least start, greatest end."""
    return block_index(df, block).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("n_records"), F.min("min_pos").alias("min_pos"), F.max("max_end").alias("max_end")
    )


def merge_summaries(parts: list[DataFrame], key: str) -> DataFrame:
    """Sums of the integer columns of summaries, by ``key``; all must have the same columns."""
    out = parts[0]
    for p in parts[1:]:
        if set(p.columns) != set(out.columns):
            raise ValueError("summaries have different columns")
        out = out.unionByName(p)
    return out.groupBy(key).agg(*(F.sum(c).cast("bigint").alias(c) for c in parts[0].columns if c != key))


def haplotype_classes(df: DataFrame) -> DataFrame:
    """Distinct genotype vectors with the number of sites that have them."""
    return df.where("gt IS NOT NULL").groupBy(F.sha2(F.to_json("gt"), 256).alias("vector")).agg(F.count(F.lit(1)).alias("n_sites"), F.min("row_idx").alias("first_row"))


def ploidy(n_samples: int) -> Column:
    return F.floor(F.size("gt") / n_samples).cast("int")
