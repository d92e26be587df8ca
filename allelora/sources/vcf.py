"""VCF text: reading into the variant schema and writing it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelora.functions.arrays import EOV, MISSING, gt_phases, let, places
from allelora.functions.text import g6
from allelora.sources.headers import with_attributes, without_subfield

#: Columns that every record has.
SITE_COLUMNS = ("row_idx", "chrom", "pos", "id", "ref", "alts", "qual", "filters", "info", "format", "gt", "ph", "undeclared", "end_pos")

#: An info entry that may have semicolons in quotes.
FIELDS = r'(?:[^;"\\]++|\\.|"(?:[^"\\]++|\\.)*+")++'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, value) of a text file, a folder or several files; compressed ones are unpacked.

    ``block`` is where in its file a task's stretch begins; line_no follows the lines of a stretch. (file, block, line_no) is the lines' order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select("file", "block", F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def header_rows(lines: DataFrame) -> DataFrame:
    """(seq, key, value) of the ``##key=value`` lines of the first file that has any, seq from 0."""
    rows = lines.where(F.col("value").startswith("##"))
    first = rows.agg(F.min("file")).first()[0]
    cut_at = F.instr("value", "=")
    # A header is as long as the declarations, whatever the number of records.
    w = W.orderBy("file", "block", "line_no")
    own = rows.where(F.col("file") == first) if first is not None else rows.where("false")
    numbered = own.withColumn("seq", F.row_number().over(w).cast("bigint") - 1)
    return numbered.select("seq", F.substring("value", F.lit(3), cut_at - 3).alias("key"), F.substring("value", cut_at + 1, F.length("value")).alias("value"))


def sample_ids(lines: DataFrame) -> list[str]:
    """Sample IDs of the #CHROM line. Raises ValueError without one, and if files differ in it: their columns would be mixed up."""
    found = lines.where(F.col("value").startswith("#CHROM")).select("value").distinct().limit(2).collect()
    if not found:
        raise ValueError("there is no #CHROM line")
    if len(found) > 1:
        raise ValueError("the files have different samples, or the same in different order")
    return found[0]["value"].split("\t")[9:]


def phasing_of(headers: DataFrame) -> str:
    """none, partial, full or unknown, by the first ``##phasing`` line."""
    row = headers.where("key = 'phasing'").orderBy("seq").first()
    named = {"none": "none", "partial": "partial", "full": "full", "phased": "full"}
    return named.get(row["value"], "unknown") if row else "unknown"


def _listed(cell: Column, sep: str) -> Column:
    return F.when(cell == ".", F.array().cast("array<string>")).otherwise(F.split(cell, sep))


def info_map(cell: Column) -> Column:
    """Info as a map of texts in the cell's order: flags have ".", the first of repeated keys counts, "." alone is the empty map.

    Entries end at semicolons outside double quotes, where a backslash takes the next character's meaning; at all semicolons if quotes don't balance.
    """
    quotes = F.regexp_count(F.regexp_replace(cell, r"\\.", ""), F.lit('"'))
    split = F.when(quotes % 2 == 1, F.split(cell, ";")).when(quotes > 0, F.regexp_extract_all(cell, F.lit(FIELDS), F.lit(0))).otherwise(F.split(cell, ";"))
    pair = lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit(".")).alias("v"))
    pairs = F.transform(F.filter(split, lambda p: ~p.isin(".", "")), pair)
    keys = lambda ps: F.transform(ps, lambda p: p["k"])
    first = lambda ps, ks: F.filter(ps, lambda p, i: F.array_position(ks, p["k"]) == i + 1)
    kept = lambda ps: let(keys(ps), lambda ks: F.when(F.size(F.array_distinct(ks)) == F.size(ks), ps).otherwise(first(ps, ks)))
    return F.map_from_entries(let(pairs, kept))


def format_types(headers: DataFrame) -> dict[str, str]:
    """FORMAT IDs but GT to element types (int, float or string), by first declaration in the header rows."""
    kinds = {"Integer": "int", "Float": "float"}
    rows = with_attributes(headers.where("key = 'FORMAT'")).where("id IS NOT NULL AND id != 'GT'").orderBy("seq").select("id", "type").collect()
    found: dict[str, str] = {}
    for r in rows:
        found.setdefault(r["id"], kinds.get(r["type"], "string"))
    return found


def column_of(field: str) -> str:
    """The column of a FORMAT field: its name in lower case, ``format_`` before it where a record has such a column already."""
    return f"format_{field.lower()}" if field.lower() in SITE_COLUMNS else field.lower()


def numbered_records(lines: DataFrame) -> DataFrame:
    """(row_idx, value): the record lines, numbered from 0 without gaps in the order of the files and their lines.

    Numbers come from counts per stretch of a file that a task reads, so nothing is sorted; there is one row per such stretch.
    """
    record = ~F.col("value").startswith("#") & (F.col("value") != "")
    rows = lines.where(record).select("file", "block", F.monotonically_increasing_id().alias("__n"), "value")
    stretches = rows.groupBy("file", "block").agg(F.min("__n").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))
    offsets = stretches.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return rows.join(offsets, ["file", "block"]).select((F.col("__n") + F.col("offset")).alias("row_idx"), "value")


def variants(lines: DataFrame, formats: dict[str, str] | None = None) -> DataFrame:
    """Records of VCF lines: row_idx, chrom, pos, id, ref, alts, qual, filters, info, format (the record's keys), gt, ph, a column (``column_of``) for
    each FORMAT field in ``formats`` (name to element type; by default all that the header declares), and ``undeclared``, the texts of the other fields.

    A record's gt is as wide as its widest call, a numeric field as its longest list; shorter ones are padded by end-of-vector marks,
    for float by NaN. ph has one element less a sample than gt. Fields that a record hasn't are null. Undeclared info keys and
    flags are kept as text. A record whose number of samples isn't that of the header raises an error.
    """
    formats = format_types(header_rows(lines)) if formats is None else formats
    width = len(sample_ids(lines)) + 9
    rows = numbered_records(lines)
    cells = F.split("value", "\t")
    cell = lambda i: F.get("cells", F.lit(i))
    # Spark may evaluate the check before the condition on rows, so it passes over other lines itself.
    no_record = F.col("value").startswith("#") | (F.col("value") == "")
    right = (F.size(cells) == width) | ((F.size(cells) == 8) & F.lit(width == 9))
    wrong = F.raise_error(F.concat(F.lit("wrong number of columns: "), "value"))
    checked = rows.select("row_idx", F.when(no_record, F.lit(None).cast("array<string>")).when(right, cells).otherwise(wrong).alias("cells"))
    samples = F.transform(F.slice("cells", F.lit(10), F.greatest(F.size("cells") - 9, F.lit(0))), lambda s: F.split(s, ":"))
    split = checked.select("row_idx", "cells", F.split(cell(8), ":").alias("format"), samples.alias("samples"))

    def values(name: Column) -> Column:
        return let(F.array_position("format", name).cast("int"), lambda at: F.when(at > 0, F.transform("samples", lambda s: F.coalesce(F.get(s, at - 1), F.lit(".")))))

    def genotypes(texts: Column, most: Column) -> Column:
        one = lambda p: F.when(p.isNull(), F.lit(EOV)).when(p == ".", F.lit(MISSING)).otherwise(p.try_cast("int"))
        return F.flatten(F.transform(texts, lambda g: let(F.split(g, r"[/|]"), lambda p: F.transform(places(most), lambda i: one(F.get(p, i))))))

    def phases(texts: Column, most: Column) -> Column:
        return F.flatten(F.transform(texts, lambda g: let(gt_phases(g), lambda p: F.transform(places(most - 1), lambda i: F.coalesce(F.get(p, i), F.lit(0))))))

    widest = lambda texts: F.greatest(F.lit(1), F.array_max(F.transform(texts, lambda g: F.size(F.split(g, r"[/|]")))))
    calls = lambda made: let(values(F.lit("GT")), lambda texts: let(widest(texts), lambda most: made(texts, most)))
    out = {"gt": calls(genotypes), "ph": calls(phases)} | {column_of(name): _typed(values(F.lit(name)), kind) for name, kind in formats.items()}
    others = F.filter("format", lambda k: ~k.isin("GT", ".", *formats))
    undeclared = F.map_from_entries(F.transform(F.array_distinct(others), lambda k: F.struct(k, values(k))))
    return split.select(
        "row_idx", cell(0).alias("chrom"), cell(1).cast("int").alias("pos"), cell(2).alias("id"), cell(3).alias("ref"),
        _listed(cell(4), ",").alias("alts"), F.when(cell(5) != ".", cell(5)).try_cast("float").alias("qual"), _listed(cell(6), ";").alias("filters"),
        info_map(cell(7)).alias("info"), "format", *(c.alias(k) for k, c in out.items()), F.when(F.size(others) > 0, undeclared).alias("undeclared"),
    )


def _typed(texts: Column, kind: str) -> Column:
    """Elements of all samples' texts in one array, each sample's padded to the longest list; texts are one element each."""
    known = lambda v, to: F.when(v != ".", v).try_cast(to)
    if kind == "string":
        return F.transform(texts, lambda s: F.when(s != ".", s))
    pad = (F.lit(EOV) if kind == "int" else F.lit(float("nan"))).cast(kind)
    lists = F.transform(texts, lambda s: F.split(s, ","))
    most = lambda x: F.array_max(F.transform(x, lambda s: F.size(s)))
    padded = lambda x, n: F.flatten(F.transform(x, lambda s: F.transform(places(n), lambda i: F.when(i < F.size(s), known(F.get(s, i), kind)).otherwise(pad))))
    return let(lists, lambda x: let(most(x), lambda n: padded(x, n)))


def with_formats(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Records whose ``undeclared`` holds all fields' texts, with the columns of ``formats`` taken out of it, typed."""
    out = df.withColumns({column_of(name): _typed(F.col("undeclared")[name], kind) for name, kind in formats.items()})
    rest = F.map_filter("undeclared", lambda k, _: ~k.isin(*formats)) if formats else F.col("undeclared")
    return out.withColumn("undeclared", F.when(F.size(rest) > 0, rest))


def gt_texts(gt: Column, ph: Column, ploidy: int | Column = 2, phasing: str = "partial") -> Column:
    """GT cells of a record: ``|`` everywhere if the file is phased, ``/`` if not, else by the phase bits; end-of-vector elements left out."""
    n = F.lit(ploidy) if isinstance(ploidy, int) else ploidy

    def one(i: Column) -> Column:
        own = F.filter(F.slice(gt, i * n + 1, n), lambda x: x != EOV)
        first = {"full": F.lit("|"), "none": F.lit("/")}.get(phasing)
        separator = lambda k: first if first is not None else F.when(F.get(ph, i * (n - 1) + k - 1) == 1, "|").otherwise("/")
        return F.array_join(F.transform(own, lambda x, k: F.concat(F.when(k == 0, F.lit("")).otherwise(separator(k)), F.when(x == MISSING, F.lit(".")).otherwise(x.cast("string")))), "")

    return F.transform(places(F.floor(F.size(gt) / n)), one)


def _cells(c: Column, kind: str, n_samples: int) -> Column:
    """Each sample's text of a field: elements joined by commas, "." for missing ones, end-of-vector marks left out."""
    text = {"int": lambda x: x.cast("string"), "float": g6, "string": lambda x: x}[kind]
    end = {"int": lambda x: x == EOV, "float": F.isnan, "string": lambda x: F.lit(False)}[kind]
    stride = F.floor(F.size(c) / n_samples).cast("int")
    own = lambda i: F.filter(F.slice(c, i * stride + 1, stride), lambda x: F.coalesce(~end(x), F.lit(True)))
    joined = lambda i: F.array_join(F.transform(own(i), lambda x: F.coalesce(text(x), F.lit("."))), ",")
    return F.when(stride > 0, F.transform(places(F.lit(n_samples)), lambda i: F.coalesce(F.nullif(joined(i), F.lit("")), F.lit("."))))


def render(df: DataFrame, ploidy: int = 2, phasing: str = "partial", n_samples: int | None = None, formats: dict[str, str] | None = None) -> DataFrame:
    """(row_idx, line): records as VCF text; info keys in the record's order, flags as bare keys, "." for nothing.

    With ``n_samples`` a record's ploidy is its own, and all fields that its ``format`` names are written, those of ``formats`` from
    their columns and others from ``undeclared``; without, only GT, of ``ploidy`` elements a sample.
    """
    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == ".", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    site = [dot(F.col("chrom")), F.col("pos").cast("string"), dot(F.col("id")), dot(F.col("ref")), dot(F.array_join("alts", ",")), dot(g6(F.col("qual"))), dot(F.array_join("filters", ";")), dot(info)]
    if n_samples is None:
        calls = F.array_join(gt_texts(F.col("gt"), F.col("ph"), ploidy, phasing), "\t")
        rest = [F.when(F.col("gt").isNotNull(), F.lit("GT")), F.when(F.col("gt").isNotNull(), calls)]
        return df.select("row_idx", F.concat_ws("\t", *(F.coalesce(c, F.lit(".")) for c in site), *rest).alias("line"))
    if n_samples == 0:
        return df.select("row_idx", F.concat_ws("\t", *(F.coalesce(c, F.lit(".")) for c in site)).alias("line"))
    own = F.greatest(F.lit(1), F.floor(F.size("gt") / n_samples).cast("int"))
    fields = [F.struct(F.lit("GT").alias("key"), gt_texts(F.col("gt"), F.col("ph"), own, phasing).alias("value"))]
    fields += [F.struct(F.lit(k).alias("key"), _cells(F.col(f"`{column_of(k)}`"), kind, n_samples).alias("value")) for k, kind in (formats or {}).items() if column_of(k) in df.columns]
    declared = F.filter(F.array(*fields), lambda e: e["value"].isNotNull())
    other = F.coalesce(F.map_entries("undeclared"), F.array().cast("array<struct<key:string,value:array<string>>>")) if "undeclared" in df.columns else F.array().cast("array<struct<key:string,value:array<string>>>")
    keyed = df.select("*", F.map_from_entries(F.concat(declared, other)).alias("__values"))
    # The record's own keys first, then fields that were added since; keys whose field is gone aren't written.
    keys = F.array_distinct(F.concat(F.filter(F.coalesce("format", F.array().cast("array<string>")), lambda k: F.map_contains_key("__values", k)), F.map_keys("__values")))
    ordered = keyed.select("*", keys.alias("__keys"))
    line_of = lambda i: F.array_join(F.transform("__keys", lambda k: F.coalesce(F.get(F.col("__values")[k], i), F.lit("."))), ":")
    cells = F.array_join(F.transform(places(F.lit(n_samples)), lambda i: F.coalesce(F.nullif(line_of(i), F.lit("")), F.lit("."))), "\t")
    return ordered.select("row_idx", F.concat_ws("\t", *(F.coalesce(c, F.lit(".")) for c in site), dot(F.array_join("__keys", ":")), cells).alias("line"))


def header_lines(headers: DataFrame, samples: list[str]) -> list[str]:
    """Header text: GT is declared as String, IDX is stripped."""
    value = without_subfield(F.col("value"), "IDX")
    gt = F.regexp_replace(F.regexp_replace(value, "Type=Integer", "Type=String"), r"Number=\.", "Number=1")
    is_gt = (F.col("key") == "FORMAT") & F.col("value").rlike(r"[<,]ID=GT[,>]")
    lines = [f"##{r[0]}={r[1]}" for r in headers.orderBy("seq").select("key", F.when(is_gt, gt).otherwise(value)).toLocalIterator()]
    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    return [*lines, "\t".join([*fixed, "FORMAT", *samples] if samples else fixed)]


def write(df: DataFrame, headers: DataFrame, samples: list[str], path: str, formats: dict[str, str], phasing: str = "partial", records_per_file: int = 0) -> None:
    """VCF text parts in the folder ``path``, in order of ``row_idx``: the first begins with the header, so read as a folder or
    joined one after another they are the file. ``records_per_file`` bounds a part's lines (0: no bound)."""
    spark = df.sparkSession
    # One row, so that the header stays in one part.
    head = [(-1, "\n".join(header_lines(headers, samples)))]
    lines = render(df, phasing=phasing, n_samples=len(samples), formats=formats)
    both = spark.createDataFrame(head, "row_idx bigint, line string").unionByName(lines)
    both.orderBy("row_idx").select("line").write.option("maxRecordsPerFile", records_per_file).text(path)
