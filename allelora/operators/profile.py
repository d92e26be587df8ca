"""Column-level data quality by character-class masks.

A value's mask has 9 for a run of digits, ``e`` for each letter e of either case, ``a`` for a run of other letters,
a blank for a run of white space, and every other character as it is. Few masks cover a column, so masks can be
counted over all rows with map-side combining; types are sets of masks; masks outside a column's dominant ones are violations; and the
difference between two loads is the distance of their mask distributions.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.functions.text import g6
from allelora.operators.skew import join_shared, running
from allelora.sources.headers import declarations

EOV = -2147483647
INTEGER_MASKS = ("9", "-9")
FLOAT_MASKS = tuple(s + n + x for s, n, x in product(("", "+", "-"), ("9", "9.", "9.9", ".9"), ("", "e9", "e+9", "e-9")))


def mask(value: Column) -> Column:
    """The character-class mask of a text; null for null."""
    text = F.regexp_replace(value, r"[0-9]+", "9")
    text = F.regexp_replace(text, r"[\p{L}&&[^eE]]+", "a")
    return F.regexp_replace(F.translate(text, "E", "e"), r"[\s\x{A0}]+", " ")


def fits_type(value: Column, kind: Column) -> Column:
    """Whether each ``,``-separated element of ``value`` is "." or has a mask of its declared type; other types always fit."""
    allowed = F.when(kind == "Integer", F.array(*map(F.lit, INTEGER_MASKS))).when(kind == "Float", F.array(*map(F.lit, FLOAT_MASKS)))
    return F.when(allowed.isNull(), True).otherwise(F.forall(F.split(mask(value), ","), lambda m: (m == ".") | F.array_contains(allowed, m)))


def info_types(headers: DataFrame) -> DataFrame:
    """(file_id, types): each file's map from INFO IDs to declared types, by first declaration."""
    decl = declarations(headers, ("INFO",)).where("type IN ('Integer', 'Float')")
    return decl.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "type"))).alias("types"))


def checked(variants: DataFrame, headers: DataFrame, slots: int) -> DataFrame:
    """Per row its verdicts bad_qual, bad_info and bad_gt, each true or false, and the numbers that ``load_profile`` sums:

    (row_idx, load_id, qual, bad_qual, n_info, bad_info, bad_gt, n_slots, n_missing, n_called, called). Null qual, info and gt
    are not bad; n_info is null for a null info, the gt numbers for a null or bad gt. ``slots`` is the length
    that a gt vector must have. Rows get their file's types without a shuffle while there are few different headers (``join_shared``), and vectors are reduced before.
    """
    q, n_alt = F.col("qual"), F.coalesce(F.size("alts"), F.lit(0))
    bad_qual = F.isnan(q) | (F.abs(q) == float("inf")) | (q < 0) | (q > 10000)
    bad_gt = (F.size("gt") != slots) | F.exists("gt", lambda x: (x != EOV) & ((x < -1) | (x > F.col("n_alt"))))
    false = F.lit(False)
    flat = variants.select("row_idx", "file_id", "load_id", "qual", "info", "gt", n_alt.alias("n_alt")).select(
        "row_idx", "file_id", "load_id", "qual", "info", "gt", F.coalesce(bad_qual, false).alias("bad_qual"), F.coalesce(bad_gt, false).alias("bad_gt")
    )
    good = F.when(~F.col("bad_gt"), F.col("gt"))
    size = lambda cond: F.when(good.isNotNull(), F.size(F.filter(good, cond)))
    narrow = flat.select(
        "row_idx", "file_id", "load_id", "qual", "bad_qual", "bad_gt", "info",
        size(lambda x: x != EOV).alias("n_slots"), size(lambda x: x == -1).alias("n_missing"), size(lambda x: x >= 0).alias("n_called"),
        F.aggregate(F.filter(good, lambda x: x >= 0), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("called"),
    )
    typed = join_shared(narrow, info_types(headers), "file_id", "types")

    def bad_entry(key: Column, value: Column) -> Column:
        kind = F.col("types")[key]
        numbers = F.transform(F.split(value, ","), lambda v: v.try_cast("double"))
        low, high = F.exists(numbers, lambda v: v < 0), F.exists(numbers, lambda v: v > 1)
        limits = F.when((key == "AF") & (kind == "Float"), low | high).when((key == "DP") & (kind == "Integer"), low).otherwise(False)
        return F.when(kind.isNull() | value.isNull(), False).otherwise(~fits_type(value, kind) | F.coalesce(limits, F.lit(False)))

    bad_info = F.exists(F.map_entries("info"), lambda e: bad_entry(e["key"], e["value"]))
    return typed.select(
        "row_idx", "load_id", "qual", "bad_qual", F.when(F.col("info").isNotNull(), F.size("info")).alias("n_info"),
        F.coalesce(bad_info, false).alias("bad_info"), "bad_gt", "n_slots", "n_missing", "n_called", "called",
    )


def bad_values(rows: DataFrame) -> DataFrame:
    """(scope = row, ref_id, field) of each broken value of ``checked`` rows."""
    fields = F.filter(F.array(*(F.when(F.col(f"bad_{f}"), F.lit(f)) for f in ("qual", "info", "gt"))), lambda x: x.isNotNull())
    return rows.select(F.lit("row").alias("scope"), F.col("row_idx").alias("ref_id"), F.explode(fields).alias("field"))


def load_profile(rows: DataFrame) -> DataFrame:
    """(load_id, field, null_rate, mean_value) of ``checked`` rows; means are null where there is nothing to average."""
    ratio = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    grouped = rows.groupBy("load_id").agg(
        share(F.col("qual").isNull()).alias("qual_null"),
        F.avg(F.when(~F.col("bad_qual"), F.col("qual").cast("double"))).alias("qual_mean"),
        share(F.col("n_info").isNull()).alias("info_null"),
        F.avg("n_info").alias("info_mean"),
        ratio("n_missing", "n_slots").alias("gt_null"),
        ratio("called", "n_called").alias("gt_mean"),
    )
    per_field = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_null").alias("null_rate"), F.col(f"{f}_mean").alias("mean_value")) for f in ("qual", "info", "gt")))
    return grouped.select("load_id", F.inline(per_field))


def drifted_loads(profile: DataFrame, baseline: DataFrame, null_rate: float = 0.1, mean: float = 0.25) -> DataFrame:
    """(scope = load, ref_id, field) of loads that differ from the baseline by more than the two limits."""
    base = baseline.select("field", F.col("null_rate").alias("n"), F.col("mean_value").alias("m"))
    off = (F.abs(F.col("null_rate") - F.col("n")) > null_rate) | (F.abs(F.col("mean_value") - F.col("m")) > mean * F.abs("m"))
    return profile.join(base, "field").where(off).select(F.lit("load").alias("scope"), F.col("load_id").alias("ref_id"), "field")


def text_form(value: Column, kind: str) -> Column:
    """A value as text: floating-point numbers by six significant digits."""
    return g6(value) if kind in ("float", "double") else value.cast("string")


def _masks(name: str, kind: str) -> Column:
    """The masks of a column's value as structs (column, mask, n): a map's values by key, an array's elements together."""
    c = F.col(f"`{name}`")
    entry = lambda column, mask, n=1: F.struct(column.alias("column"), mask.alias("mask"), F.lit(n).cast("bigint").alias("n") if isinstance(n, int) else n.cast("bigint").alias("n"))
    whole = ("tinyint", "smallint", "int", "bigint")
    if kind in whole:
        return F.array(entry(F.lit(name), F.when(c < 0, "-9").when(c >= 0, "9")))
    if kind.startswith("array<") and kind[6:-1] in whole:
        # Integers have two masks: elements are counted in the row, not laid out.
        count = lambda cond: F.size(F.filter(c, cond))
        return F.when(c.isNotNull(), F.array(entry(F.lit(name), F.lit("-9"), count(lambda x: x < 0)), entry(F.lit(name), F.lit("9"), count(lambda x: x >= 0))))
    if kind.startswith("map"):
        return F.transform(F.map_entries(c), lambda e: entry(F.concat(F.lit(f"{name}."), e["key"].cast("string")), mask(e["value"].cast("string"))))
    if kind.startswith("array"):
        return F.transform(c, lambda x: entry(F.lit(name), mask(text_form(x, kind[6:-1]))))
    return F.array(entry(F.lit(name), mask(text_form(c, kind))))


def mask_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    """(column, mask, n), or also by the values of the column ``by``: how often each mask occurs, nulls left out.

    Maps count by key, as ``name.key``, arrays by element. One pass over the table; masks are counted before the shuffle.
    """
    empty = F.array().cast("array<struct<column:string,mask:string,n:bigint>>")
    parts = [F.coalesce(_masks(n, k), empty) for n, k in df.dtypes if n != by]
    keys = [] if by is None else [F.col("__by").alias(by)]
    rows = df.select(*([] if by is None else [F.col(by).alias("__by")]), F.inline(F.concat(*parts)))
    return rows.where("mask IS NOT NULL AND n > 0").groupBy(*keys, "column", "mask").agg(F.sum("n").alias("n"))


def _mined(df: DataFrame, coverage: float) -> DataFrame:
    """(column, mask, n, total, before): ``before`` is the number of values with more frequent masks, or as frequent and smaller ones."""
    counts = mask_counts(df)
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    placed = running(counts.withColumn("__down", -F.col("n")), "column", ["__down", "mask"], ("n",))
    return placed.join(total, "column").select("column", "mask", "n", "total", (F.col("before_n") < coverage * F.col("total")).alias("dominant"))


def dominant_masks(df: DataFrame, coverage: float = 0.95) -> DataFrame:
    """(column, mask, n, total): the dominant masks of each column, its most frequent ones until they cover ``coverage`` of its values."""
    return _mined(df, coverage).where("dominant").drop("dominant")


def rare_masks(df: DataFrame, coverage: float = 0.95) -> DataFrame:
    """(column, mask, n, total): the pattern violations of each column, of any size: all masks that aren't among its dominant ones."""
    return _mined(df, coverage).where("NOT dominant").drop("dominant")


def mask_divergence(df: DataFrame, by: str) -> DataFrame:
    """(by, column, n, divergence): total variation distance between a load's masks of a column and those of all loads.

    0 for equal distributions, 1 for disjoint ones. Rows whose ``by`` is null form a load of their own.
    """
    counts = mask_counts(df, by)
    overall = counts.groupBy("column", "mask").agg(F.sum("n").alias("n_all"))
    total = overall.groupBy("column").agg(F.sum("n_all").alias("t_all"))
    load_total = counts.groupBy(by, "column").agg(F.sum("n").alias("t")).withColumnRenamed(by, "__load")
    shares = (
        counts.join(overall, ["column", "mask"]).join(total, "column")
        .join(load_total.withColumnRenamed("column", "__column"), (F.col("column") == F.col("__column")) & F.col(by).eqNullSafe(F.col("__load")))
        .select(by, "column", "t", (F.col("n") / F.col("t")).alias("p"), (F.col("n_all") / F.col("t_all")).alias("q"))
    )
    distance = (F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2
    return shares.groupBy(by, "column", F.col("t").alias("n")).agg(F.round(distance, 6).alias("divergence"))


def _kind(kind: str) -> str:
    return "number" if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else "text"


def value_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, n_nan, n_infinite, n_distinct, least, greatest) of all columns and of what maps and arrays hold.

    Maps and arrays count as wholes, their extremes are those of their size; ``name[]`` are an array's elements, ``name.key`` a map's values of
    one key, null in rows without it. Extremes are those of finite numbers, NaN and infinities being counted apart, and
    otherwise those of the texts; a map's values are numbers if all of them but "." are. n_distinct is exact: values are counted per
    distinct text (wholes by SHA-256) before columns are. An empty table has n_rows 0 and null extremes for each of its columns.
    """
    entry = lambda name, kind, value, size=None: F.struct(name.alias("column"), F.lit(kind).alias("kind"), value.cast("string").alias("value"), (F.lit(None) if size is None else size).cast("int").alias("size"))
    parts, plain, names = [], [], []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if not kind.startswith(("map", "array", "struct")):
            plain.append((name, _kind(kind), df.select(c.alias("value"))))
            names.append((name, _kind(kind), None, None, 0))
            continue
        size = None if kind.startswith("struct") else F.when(c.isNotNull(), F.size(c))
        ordered = F.sort_array(F.map_entries(c)) if kind.startswith("map") else c
        parts.append(F.array(entry(F.lit(name), "whole", F.when(c.isNotNull(), F.sha2(F.to_json(F.struct(ordered.alias("v"))), 256)), size)))
        names.append((name, "whole", None, None, 0))
        if kind.startswith("map"):
            parts.append(F.transform(F.map_entries(c), lambda e: entry(F.concat(F.lit(f"{name}."), e["key"].cast("string")), "entry", e["value"])))
        elif kind.startswith("array"):
            inner = kind[6:-1]
            nested = inner.startswith(("map", "array", "struct"))
            elements = F.transform(c, F.to_json) if nested else c
            plain.append((f"{name}[]", _kind(inner), df.select(F.explode(elements).alias("value"))))
            names.append((f"{name}[]", _kind(inner), None, None, 0))
    # One Generate for each part: one array of all values of a row would be built in full before it is laid out.
    long = None
    for part in parts:
        one = df.select(F.inline(part)).groupBy("column", "kind", "value", "size").agg(F.count(F.lit(1)).alias("n"))
        long = one if long is None else long.unionByName(one)
    # Values of one type are counted as they are and become texts afterwards.
    for name, kind, values in plain:
        one = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(entry(F.lit(name), kind, F.col("value")))), "n")
        long = one if long is None else long.unionByName(one)
    none = df.sparkSession.createDataFrame(names, "column string, kind string, value string, size int, n bigint")
    text = F.col("value")
    number = F.when((F.col("kind") == "number") | text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z") | F.lower(text).isin("nan", "inf", "+inf", "-inf", "infinity", "-infinity"), text.try_cast("double"))
    nan, infinite = F.coalesce(F.isnan("x"), F.lit(False)), F.coalesce(F.abs("x") == float("inf"), F.lit(False))
    counted = long.unionByName(none).withColumn("x", F.when(F.col("kind").isin("number", "entry"), number))
    exact = F.when(F.col("x").isNotNull() & ~nan & ~infinite, F.struct("x", F.coalesce(text.try_cast("decimal(38,0)"), F.lit(0)).alias("i"), "value"))
    sums = counted.groupBy("column", "kind").agg(
        F.sum("n").alias("all"), F.coalesce(F.sum(F.when(text.isNotNull(), F.col("n"))), F.lit(0)).alias("known"), F.coalesce(F.sum(F.when(nan, F.col("n"))), F.lit(0)).alias("n_nan"),
        F.coalesce(F.sum(F.when(infinite, F.col("n"))), F.lit(0)).alias("n_infinite"), F.count("value").alias("n_distinct"),
        F.bool_and(text.isNull() | (F.col("kind") == "entry") & (text == ".") | F.col("x").isNotNull()).alias("numbers"), F.count("x").alias("n_numbers"),
        F.min(exact).alias("low"), F.max(exact).alias("high"), F.min("value").alias("first"), F.max("value").alias("last"), F.min("size").alias("small"), F.max("size").alias("large"),
    )
    rows = F.when(F.col("kind") == "entry", F.col("rows")).otherwise(F.col("all"))
    numeric = (F.col("kind") == "number") | F.col("numbers") & (F.col("n_numbers") > 0)
    extreme = lambda number, text, size: F.when(F.col("kind") == "whole", F.col(size).cast("string")).when(numeric, F.col(f"{number}.value")).otherwise(F.col(text))
    return sums.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("rows")))).select(
        "column", rows.alias("n_rows"), (rows - F.col("known")).alias("n_null"), "n_nan", "n_infinite", "n_distinct", extreme("low", "first", "small").alias("least"), extreme("high", "last", "large").alias("greatest")
    )


def profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, n_distinct, least, greatest) of ``value_profile``."""
    return value_profile(df).drop("n_nan", "n_infinite")
