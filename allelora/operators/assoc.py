"""Per-variant association with a phenotype."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.functions.arrays import EOV, stride_reduce
from allelora.functions.batches import dosage_blocks
from allelora.functions.tdist import two_sided


def phenotypes(samples: DataFrame, pheno: DataFrame, id_col: str = "sample_id", y: str = "y") -> DataFrame:
    """Inner join of samples with phenotypes by ID in genotype order, rows without a number dropped.

    Of several rows of one ID the last by ``line`` (a column of ``pheno``) counts. Missing is null or NaN.
    """
    last = pheno.groupBy(id_col).agg(F.max_by(y, "line").alias(y))
    return samples.join(last.where(F.col(y).isNotNull() & ~F.isnan(y)), id_col).select("sample_idx", id_col, y)


def residuals(y: np.ndarray, covariates: np.ndarray) -> np.ndarray:
    """Residuals of least squares on the covariates and an intercept."""
    x = np.column_stack([np.ones(len(y)), covariates]) if covariates.size else np.ones((len(y), 1))
    return y - x @ (np.linalg.pinv(x) @ y)


def residuals_logit(y: np.ndarray, covariates: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Residuals of a logistic regression: Newton steps from the least-squares solution."""
    x = np.column_stack([np.ones(len(y)), covariates]) if covariates.size else np.ones((len(y), 1))
    beta = np.linalg.pinv(x) @ y
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        w = p * (1 - p)
        beta = beta + np.linalg.pinv((x.T * w) @ x) @ (x.T @ (y - p))
    return y - 1 / (1 + np.exp(-x @ beta))


def dosages(n_samples: int) -> Column:
    """Alternative alleles per sample of gt, null for a sample with a missing allele; end-of-vector elements left out."""
    ploidy = F.floor(F.size("gt") / n_samples).cast("int")
    part = lambda i: F.filter(F.slice("gt", i * ploidy + 1, ploidy), lambda x: x != EOV)
    one = lambda i: F.when(~F.exists(part(i), lambda x: x < 0), F.aggregate(part(i), F.lit(0.0), lambda a, x: a + x))
    return F.when(F.size("gt") >= n_samples, F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), one))


def moments(x: Column, y: dict[int, float]) -> Column:
    """n, sums and products of (dosage, response) over the samples in ``y`` with a dosage, in one pass over the vector.

    ``y`` has one number per sample and is part of the plan: its size is that of the sample list, not of the data.
    """
    top = max(y, default=-1) + 1
    response = F.array(*(F.lit(float(y[i])) if i in y else F.lit(None).cast("double") for i in range(top)))
    zero = F.lit(0.0)
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    start = F.struct(*(zero.alias(k) for k in names))
    pairs = F.filter(F.transform(x, lambda d, i: F.struct(d.cast("double").alias("x"), F.get(response, i).alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def step(a: Column, p: Column) -> Column:
        d, r = p["x"], p["y"]
        terms = {"n": F.lit(1.0), "sx": d, "sy": r, "sxx": d * d, "sxy": d * r, "syy": r * r}
        return F.struct(*((a[k] + v).alias(k) for k, v in terms.items()))

    return F.aggregate(pairs, start, step)


def site_moments(df: DataFrame, y: dict[int, float], n_samples: int, keep: tuple[str, ...] = ("row_idx", "chrom", "pos")) -> DataFrame:
    """``keep`` columns and m, the ``moments`` of each site's dosages, one matrix product per Arrow batch.

    A site without a usable vector has n = 0. The same numbers as ``moments(dosages(n_samples), y)``.
    """
    used = sorted(i for i in y if i < n_samples)
    response = np.array([y[i] for i in used])
    weights = np.column_stack([np.ones(len(used)), response, response * response])
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    schema = df.select(*keep, F.struct(*(F.lit(0.0).alias(k) for k in names)).alias("m")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 6))
            for rows, ds in dosage_blocks(batch.column(len(keep)), n_samples):
                x = ds[:, used]
                known = ~np.isnan(x)
                x = np.where(known, x, 0)
                n, sy, syy = (known @ weights).T
                sx, sxy, _ = (x @ weights).T
                out[rows] = np.column_stack([n, sx, sy, (x * x).sum(axis=1), sxy, syy])
            m = pa.StructArray.from_arrays([pa.array(c) for c in out.T.copy()], names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], m], names=[*keep, "m"])

    return df.select(*keep, "gt").mapInArrow(scan, schema)


def sparse_moments(s: Column, y: dict[int, float]) -> Column:
    """``moments`` from a sparse dosage vector: only its stored elements are touched. Missing elements (null) are stored; their samples
    are taken off the sums over all responses."""
    top = max(y, default=-1) + 1
    response = F.array(*(F.lit(float(y[i])) if i in y else F.lit(None).cast("double") for i in range(top)))
    pairs = F.filter(F.transform(s["offsets"], lambda o, i: F.struct(F.get(s["values"], i).cast("double").alias("x"), F.get(response, o).alias("y"))), lambda p: p["y"].isNotNull())
    zero = {k: F.lit(0.0) for k in ("n", "sx", "sxx", "sxy")}
    start = {**zero, "n": F.lit(float(len(y))), "sy": F.lit(float(sum(y.values()))), "syy": F.lit(float(sum(v * v for v in y.values())))}
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")

    def step(a: Column, p: Column) -> Column:
        x, r = p["x"], p["y"]
        gone = lambda v: F.when(x.isNull(), v).otherwise(0.0)
        here = lambda v: F.coalesce(v, F.lit(0.0))
        terms = {"n": -gone(F.lit(1.0)), "sx": here(x), "sy": -gone(r), "sxx": here(x * x), "sxy": here(x * r), "syy": -gone(r * r)}
        return F.struct(*((a[k] + terms[k]).alias(k) for k in names))

    return F.when(s.isNotNull(), F.aggregate(pairs, F.struct(*(start[k].alias(k) for k in names)), step))


def regression(df: DataFrame, m: str = "m") -> DataFrame:
    """``df`` with beta, se, t, intercept and r2 from its moments; null where they aren't defined."""
    c = lambda k: F.col(f"{m}.{k}")
    vx, vy = c("n") * c("sxx") - c("sx") * c("sx"), c("n") * c("syy") - c("sy") * c("sy")
    cxy = c("n") * c("sxy") - c("sx") * c("sy")
    out = df.withColumn("beta", F.try_divide(cxy, vx))
    se2 = F.try_divide(vy - F.col("beta") * F.col("beta") * vx, (c("n") - 2) * vx)
    out = out.withColumn("se", F.when((c("n") > 2) & se2.isNotNull(), F.sqrt(F.greatest(se2, F.lit(0.0)))))
    out = out.withColumn("t", F.try_divide(F.col("beta"), F.col("se")))
    out = out.withColumn("intercept", F.try_divide(c("sy") - F.col("beta") * c("sx"), c("n")))
    return out.withColumn("r2", F.try_divide(cxy * cxy, vx * vy))


def with_p(df: DataFrame, m: str = "m") -> DataFrame:
    """``df`` with pval of t at n - 2 degrees of freedom."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(two_sided(t.to_numpy(float), n.to_numpy(float) - 2))

    return df.withColumn("pval", F.when(F.col("t").isNotNull(), p(F.col("t"), F.col(f"{m}.n"))))


def minor_counts(m: str = "m", ploidy: int = 2) -> tuple[Column, Column]:
    """(mac, maf) of the samples that take part: counts above half of all alleles are folded."""
    ac, an = F.col(f"{m}.sx"), F.col(f"{m}.n") * ploidy
    af = F.try_divide(ac, an)
    return F.when(ac > F.floor(an / 2), an - ac).otherwise(ac), F.when(af > 0.5, 1 - af).otherwise(af)


def associate(df: DataFrame, y: dict[int, float], n_samples: int, min_mac: float = 1.0) -> DataFrame:
    """(row_idx, chrom, pos, maf, mac, beta, se, t, pval) of each site with mac of at least ``min_mac``."""
    sites = site_moments(df, y, n_samples)
    mac, maf = minor_counts()
    kept = sites.withColumn("mac", mac).withColumn("maf", maf).where(F.col("mac") >= min_mac)
    return with_p(regression(kept)).select("row_idx", "chrom", "pos", "maf", "mac", "beta", "se", "t", "pval")


def regress_many(df: DataFrame, y: dict[int, float], covariates: dict[int, list[float]], n_samples: int) -> DataFrame:
    """Least squares of y on intercept, covariates and dosage, per site: (row_idx, beta, se, t).

    The normal equations of all sites of an Arrow batch are made by matrix products and solved together. Sites with a missing dosage
    use the samples that have one. Sites that are singular or have no more samples than coefficients, and sites without a vector, give nulls.
    """
    used = sorted(i for i in set(y) & set(covariates) if i < n_samples)
    response = np.array([y[i] for i in used], float)
    base = np.column_stack([np.ones(len(used)), np.array([covariates[i] for i in used], float).reshape(len(used), -1)])
    k = base.shape[1] + 1
    products = (base[:, :, None] * base[:, None, :]).reshape(len(used), -1)

    def solved(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        x = np.where(known, x, 0)
        gram = np.empty((len(x), k, k))
        gram[:, :-1, :-1] = (known @ products).reshape(len(x), k - 1, k - 1)
        gram[:, -1, :-1] = gram[:, :-1, -1] = x @ base
        gram[:, -1, -1] = (x * x).sum(axis=1)
        right = np.column_stack([known @ (base * response[:, None]), x @ response])
        out = np.full((len(x), 3), np.nan)
        n = known.sum(axis=1)
        good = (n > k) & (np.linalg.matrix_rank(gram) == k)
        if good.any():
            inverse = np.linalg.inv(gram[good])
            b = np.einsum("rij,rj->ri", inverse, right[good])
            rest = known[good] @ (response * response) - (b * right[good]).sum(axis=1)
            se = np.sqrt(np.maximum(rest, 0) / (n[good] - k) * inverse[:, -1, -1])
            with np.errstate(divide="ignore", invalid="ignore"):
                out[good] = np.column_stack([b[:, -1], se, np.where(se > 0, b[:, -1] / se, np.nan)])
        return out

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full((batch.num_rows, 3), np.nan)
            for rows, ds in dosage_blocks(batch.column(1), n_samples):
                out[rows] = solved(ds[:, used])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, from_pandas=True) for c in out.T)], names=["row_idx", "beta", "se", "t"])

    return df.select("row_idx", "gt").mapInArrow(solve, "row_idx bigint, beta double, se double, t double")


def associate_sites(df: DataFrame, y: dict[int, float], covariates: dict[int, list[float]] | None = None, field: str | None = None, n_samples: int = 0, min_mac: float = 1.0, logit: bool = False) -> DataFrame:
    """(row_idx, chrom, pos, maf, mac, beta, se, t, pval) per site, as a whole association run does it.

    The response is what ``covariates`` leave of y, by least squares or, with ``logit``, by a logistic regression; they aren't projected out of the
    dosages. Dosages come from ``field``: ds, hds or gt, by default the first of these that is a column of ``df``; null or NaN elements are missing.
    Allele counts are those of the site's AC and AN, else of its AF over all samples, else of the samples that take part. Sites without any dosage are left out.
    """
    used = sorted(i for i in y if (not covariates or i in covariates) and i < n_samples)
    if covariates:
        left = (residuals_logit if logit else residuals)(np.array([y[i] for i in used]), np.array([covariates[i] for i in used], float))
        y = dict(zip(used, left.tolist()))
    columns = {c.lower() for c in df.columns}
    field = field or next((f for f in ("ds", "hds", "gt") if f in columns), None)
    if field not in ("ds", "hds", "gt") or field not in columns:
        raise ValueError("there is no column ds, hds or gt")
    keep = ("row_idx", "chrom", "pos", "info")
    if field == "gt":
        rows = site_moments(df, {i: y[i] for i in used}, n_samples, keep)
    else:
        number = lambda x: F.when(~F.isnan(x), x.cast("double"))
        per_sample = F.transform("ds", number) if field == "ds" else stride_reduce(F.transform("hds", number), 2, F.lit(0.0), lambda a, x: a + x)
        rows = df.select(*keep, F.coalesce(moments(per_sample, {i: y[i] for i in used}), moments(F.array().cast("array<double>"), {})).alias("m"))
    number = lambda key: F.split(F.col("info")[key], ",")[0].try_cast("double")
    known = number("AC").isNotNull() & number("AN").isNotNull()
    an = F.when(known, number("AN")).when(number("AF").isNotNull(), F.lit(2.0 * n_samples)).otherwise(F.col("m.n") * 2)
    ac = F.when(known, number("AC")).when(number("AF").isNotNull(), number("AF") * 2.0 * n_samples).otherwise(F.col("m.sx"))
    counted = rows.withColumn("__ac", ac).withColumn("__an", an)
    af = F.try_divide(F.col("__ac"), F.col("__an"))
    mac = F.when(F.col("__ac") > F.floor(F.col("__an") / 2), F.col("__an") - F.col("__ac")).otherwise(F.col("__ac"))
    sites = counted.withColumn("mac", mac).withColumn("maf", F.when(af > 0.5, 1 - af).otherwise(af)).where((F.col("mac") >= min_mac) & (F.col("m.n") > 0))
    return with_p(regression(sites)).select("row_idx", "chrom", "pos", "maf", "mac", "beta", "se", "t", "pval")
