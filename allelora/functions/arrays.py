"""Vector operations on array columns: dense and sparse vectors over samples x ploidy.

A sparse vector is struct<size int, offsets array<int>, values array<T>>: absolute offsets of the elements that aren't
exactly zero. Missing elements (null, or -1 in genotype vectors) and end-of-vector marks count as non-zero.
All functions give null for a null vector and keep the vector's order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EOV = -2147483647
MISSING = -1


def places(n: Column) -> Column:
    """array [0, 1, ..., n - 1], empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).when(n.isNotNull(), F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; expressions that use a vector several times need it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plus_eov(a: Column, b: Column) -> Column:
    """Sum that passes over an end-of-vector mark on the right."""
    return F.when(b == EOV, a).otherwise(a + b)


def stride_reduce(v: Column, stride: int, zero: Column | None = None, op=plus_eov) -> Column:
    """Folds each ``stride`` consecutive elements. A first element that is an end-of-vector mark counts as zero.
    An element that is null makes its sample null. Length must be a multiple of ``stride``."""
    start = F.lit(0).cast("bigint") if zero is None else zero
    folded = lambda x: F.transform(places(F.floor(F.size(x) / stride)), lambda i: F.aggregate(F.slice(x, i * stride + 1, F.lit(stride)), start, op))
    return F.when(v.isNotNull(), let(v, folded))


def to_sparse(v: Column) -> Column:
    """Sparse form of a dense vector; nulls and NaN are kept, only exact zeros are dropped."""
    return let(v, lambda x: F.when(x.isNotNull(), let(_nonzero(F.transform(x, lambda y, i: F.struct(i.alias("o"), y.alias("x")))), lambda kept: _sparse(F.size(x), kept))))


def _nonzero(pairs: Column) -> Column:
    return F.filter(pairs, lambda e: F.coalesce(e["x"] != 0, F.lit(True)))


def _sparse(size: Column, pairs: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), F.transform(pairs, lambda e: e["o"]).alias("offsets"), F.transform(pairs, lambda e: e["x"]).alias("values"))


def to_dense(s: Column, kind: str = "int") -> Column:
    """Dense form of a sparse vector: stretches of zeros between the values, linear in its size."""
    return let(s, lambda x: _dense(x, F.lit(0).cast(kind)))


def _dense(s: Column, zero: Column) -> Column:
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(s["offsets"], i - 1))
    parts = F.transform(s["offsets"], lambda o, i: F.concat(F.array_repeat(zero, o - before(i) - 1), F.slice(s["values"], i + 1, F.lit(1))))
    last = F.coalesce(F.get(s["offsets"], F.size(s["offsets"]) - 1), F.lit(-1))
    return F.when(s.isNotNull(), F.concat(F.flatten(parts), F.array_repeat(zero, s["size"] - last - 1)))


def is_sparse_enough(v: Column, threshold: float) -> Column:
    """Whether the share of non-zeros is at most ``threshold``."""
    return F.try_divide(F.size(F.filter(v, lambda x: F.coalesce(x != 0, F.lit(True)))), F.size(v)) <= threshold


def delta_encode(offsets: Column) -> Column:
    """Gaps to the offset before, less one."""
    return let(offsets, lambda x: F.transform(x, lambda o, i: o - F.when(i == 0, F.lit(0)).otherwise(F.get(x, i - 1) + 1)))


def delta_decode(gaps: Column) -> Column:
    """Offsets from gaps: running sums, in one fold."""
    step = lambda a, g: F.struct((a["next"] + g + 1).alias("next"), F.concat(a["out"], F.array((a["next"] + g).cast("int"))).alias("out"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))
    return F.when(gaps.isNotNull(), F.aggregate(gaps, start, step, lambda a: a["out"]))


def subset(v: Column, keep: list[int], stride: int | Column) -> Column:
    """The elements of the samples ``keep`` (indices), in file order; ``stride`` elements a sample, which may differ from row to row."""
    kept = sorted(set(keep))
    if not kept:
        return F.when(v.isNotNull(), F.slice(v, 1, 0))
    # Neighbouring samples are cut out together.
    runs: list[list[int]] = []
    for k in kept:
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    return F.concat(*(F.slice(v, a * stride + 1, (b - a) * stride) for a, b in runs))


def sparse_subset(s: Column, keep: list[int], stride: int, n_samples: int) -> Column:
    """``subset`` on a sparse vector; work follows the number of non-zeros."""
    kept = sorted(set(keep))
    new = {k: i for i, k in enumerate(kept)}
    table = F.array(*(F.lit(new.get(i, -1)) for i in range(n_samples)))
    place = lambda o: F.get(table, F.floor(o / stride).cast("int"))

    def moved(x: Column) -> Column:
        all_moved = F.transform(x["offsets"], lambda o, i: F.struct(F.when(place(o) >= 0, (place(o) * stride + o % stride).cast("int")).alias("o"), F.get(x["values"], i).alias("x")))
        return let(F.filter(all_moved, lambda e: e["o"].isNotNull()), lambda rest: _sparse(F.lit(len(kept) * stride), rest))

    return let(s, lambda x: F.when(x.isNotNull(), moved(x)))


def sparse_stride_reduce(s: Column, stride: int) -> Column:
    """``stride_reduce`` on a sparse vector: one fold over the non-zeros; sums that come to zero are dropped."""
    value = lambda x: F.when(x == EOV, F.lit(0)).otherwise(x).cast("bigint")

    def reduced(x: Column) -> Column:
        size = F.floor(x["size"] / stride).cast("int")
        group = lambda i: F.floor(F.get(x["offsets"], i) / stride).cast("int")
        # A sample's non-zeros stand together: its first one sums those that follow, up to stride of them.
        own = lambda i: [F.when(group(i + k) == group(i), value(F.get(x["values"], i + k))).otherwise(F.lit(0).cast("bigint")) for k in range(1, stride)]
        first = lambda i: (i == 0) | (group(i - 1) != group(i))
        sums = F.transform(x["values"], lambda y, i: F.when(first(i) & (group(i) < size), F.struct(group(i).alias("o"), sum(own(i), value(y)).alias("x"))))
        return let(_nonzero(F.filter(sums, lambda e: e.isNotNull())), lambda kept: _sparse(size, kept))

    return let(s, lambda x: F.when(x.isNotNull(), reduced(x)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two dense vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, p: t + p)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse vectors, over the offsets of both."""
    at = lambda s, o: F.get(s["values"], F.array_position(s["offsets"], o).cast("int") - 1)
    both = lambda x, y: F.transform(F.array_intersect(x["offsets"], y["offsets"]), lambda o: at(x, o) * at(y, o))
    return F.aggregate(let(a, lambda x: let(b, lambda y: both(x, y))), F.lit(0.0), lambda t, p: t + p)


def gt_alleles(text: Column, ploidy: int = 2) -> Column:
    """Alleles of a GT text: -1 for ".", end-of-vector marks up to ``ploidy``."""
    parts = F.split(text, r"[/|]")
    one = lambda i: F.when(F.get(parts, i).isNull(), F.lit(EOV)).when(F.get(parts, i) == ".", F.lit(MISSING)).otherwise(F.get(parts, i).try_cast("int"))
    return F.when(text.isNotNull(), F.transform(places(F.lit(ploidy)), one))


def gt_phases(text: Column) -> Column:
    """1 for each ``|`` of a GT text, 0 for each ``/``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[/|]"), F.lit(0)), lambda c: (c == "|").cast("int"))


def bcf_encode(gt: Column, ph: Column, ploidy: int = 2) -> Column:
    """BCF codes of alleles: (allele + 1) * 2, plus the phase bit of the separator before it; marks stay marks."""
    def code(x: Column, i: Column) -> Column:
        sample, hap = F.floor(i / ploidy).cast("int"), i % ploidy
        phased = F.when(hap > 0, F.coalesce(F.get(ph, sample * (ploidy - 1) + hap - 1), F.lit(0))).otherwise(0)
        return F.when(x == EOV, x).otherwise(F.shiftleft(x + 1, 1) + phased)

    return F.transform(gt, code)


def bcf_decode(codes: Column) -> Column:
    """Alleles of BCF codes, -1 where missing."""
    return F.transform(codes, lambda c: F.when(c == EOV, c).otherwise(F.shiftright(c, 1) - 1))


def allele_counts(gt: Column, alts: Column) -> Column:
    """AC: how often each alternative allele occurs; empty without alternatives."""
    return F.transform(alts, lambda _, i: F.size(F.filter(gt, lambda x: x == i + 1)))


def hds_to_ds(hds: Column, ploidy: int = 2) -> Column:
    """Dosage per sample: the sum of its haplotype dosages."""
    return stride_reduce(hds.cast("array<double>"), ploidy, F.lit(0.0), lambda a, x: a + x)


def hds_to_gt(hds: Column) -> Column:
    """Hard calls of haplotype dosages."""
    return F.transform(hds, lambda x: F.floor(x + 0.5).cast("int"))


def hds_to_gp(hds: Column, ploidy: int = 2) -> Column:
    """Genotype probabilities (ploidy + 1 per sample) of haplotype dosages: Poisson-binomial by dynamic programming."""
    def one(i: Column) -> Column:
        start = F.array(F.lit(1.0), *[F.lit(0.0)] * ploidy)

        def add(state: Column, p: Column) -> Column:
            return F.transform(state, lambda x, k: x * (1 - p) + F.coalesce(F.get(state, k - 1), F.lit(0.0)) * p)

        return F.aggregate(F.slice(hds.cast("array<double>"), i * ploidy + 1, F.lit(ploidy)), start, add)

    return F.when(hds.isNotNull(), F.flatten(F.transform(places(F.floor(F.size(hds) / ploidy)), one)))


def sample_stride(field: str, ploidy: int) -> int:
    """Values per sample of a FORMAT field."""
    if field in ("GT", "HDS"):
        return ploidy
    if field in ("GP", "GL", "PL"):
        return ploidy + 1
    return 1

