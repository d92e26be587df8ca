"""Rows that fail to parse, apart from the valid ones and with their reasons.

Every column is read as nullable text; rules are vectorised conditions; a row's failed rules form its
error array, and rows are split by whether that array is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.functions.arrays import EOV, let
from allelora.operators.skew import join_back
from allelora.sources.vcf import info_map


def with_errors(df: DataFrame, rules: list[tuple[str, Column]], out: str = "errors") -> DataFrame:
    """``df`` with the names of the rules that hold for a row, in order. A rule whose condition is null doesn't hold."""
    return df.withColumn(out, F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules)), lambda x: x.isNotNull()))


def split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failed rows with ``errors``); together they are all rows of ``df``."""
    marked = with_errors(df, rules)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def vcf_rows(lines: DataFrame) -> DataFrame:
    """Lines of VCF text as text cells: (line_id, file_no, line, cells, width), without the #CHROM lines.

    ``width`` is the number of columns of the file's #CHROM line, its first if there are several, null if none.
    A trailing carriage return is taken off. A file may hold a third of all lines: its lines aren't
    sent to one task.
    """
    clean = lines.select("line_id", "file_no", "line_no", F.regexp_replace("line", r"\r\z", "").alias("line"))
    is_head = F.coalesce(F.col("line").startswith("#CHROM"), F.lit(False))
    heads = clean.groupBy("file_no").agg(
        F.min(F.when(is_head, F.struct("line_no", F.size(F.split("line", "\t")).alias("width")))).alias("h"), F.count(F.lit(1)).alias("n_lines")
    ).select("file_no", "n_lines", F.col("h.width").alias("width"))
    rows = join_back(clean.where(~is_head), heads, "file_no", "n_lines")
    return rows.select("line_id", "file_no", "line", F.split("line", "\t").alias("cells"), "width")


def vcf_rules() -> list[tuple[str, Column]]:
    """The reasons for which a line of VCF text fails, in order of precedence."""
    line, cells = F.col("line"), F.col("cells")
    quotes = lambda t: F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))
    escaped = (F.length(line) - F.length(F.replace(line, F.lit('\\"'), F.lit("")))) / 2
    pos = F.get(cells, F.lit(1))
    digits = F.regexp_replace(pos, r"\A0+", "")
    pos_ok = pos.rlike(r"\A[0-9]+\z") & (F.length(digits) <= 10) & F.substring(digits, 1, 10).try_cast("bigint").between(1, 2147483647)
    alt = F.get(cells, F.lit(4))
    n_alt = F.when(alt == ".", 0).otherwise(F.size(F.split(alt, ",")))
    calls = F.transform(F.slice(cells, F.lit(10), F.greatest(F.size(cells) - 9, F.lit(0))), lambda c: F.substring_index(c, ":", 1))

    def call_ok(gt: Column) -> Column:
        allele = lambda a: (a == ".") | (F.length(F.regexp_replace(a, r"\A0+", "")) <= 9) & (F.substring(F.regexp_replace(a, r"\A0+(?=.)", ""), 1, 9).try_cast("int") <= n_alt)
        return gt.rlike(r"\A(?:\.|[0-9]+)(?:[/|](?:\.|[0-9]+))?\z") & F.coalesce(F.forall(F.split(gt, r"[/|]"), allele), F.lit(False))

    return [
        ("column_count", ~F.coalesce(F.size(cells).eqNullSafe(F.col("width")), F.lit(False))),
        ("quoting", (quotes(line) - escaped) % 2 == 1),
        ("bad_pos", ~F.coalesce(pos_ok, F.lit(False))),
        ("bad_gt", F.exists(calls, lambda c: ~F.coalesce(call_ok(c), F.lit(False)))),
    ]


def vcf_sites(valid: DataFrame) -> DataFrame:
    """Typed sites of valid rows: info as a map of texts (flags "."), gt with two slots a sample: -1 missing, EOV unused; ph 1 where a call is
    phased; gq and dp by the line's FORMAT keys, null where it hasn't the key, null elements where a sample hasn't the number.
    """
    cell = lambda i: F.get("cells", F.lit(i))
    listed = lambda c, sep: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    allele = lambda a: F.when(a.isNull(), F.lit(EOV)).when(a == ".", F.lit(-1)).otherwise(a.try_cast("int"))
    samples = F.slice("cells", F.lit(10), F.greatest(F.size("cells") - 9, F.lit(0)))
    call = lambda c: F.substring_index(c, ":", 1)
    gt = F.flatten(F.transform(samples, lambda c: F.transform(F.array(F.lit(0), F.lit(1)), lambda i: allele(F.get(F.split(call(c), r"[/|]"), i)))))
    place = lambda key: F.array_position(F.split(cell(8), ":"), key).cast("int")
    number = lambda key: F.when(place(key) > 0, let(place(key), lambda at: F.transform(samples, lambda c: F.get(F.split(c, ":"), at - 1).try_cast("int"))))
    return valid.select(
        "line_id", "file_no", cell(0).alias("chrom"), cell(1).try_cast("int").alias("pos"), cell(2).alias("id"), cell(3).alias("ref"), listed(cell(4), ",").alias("alts"),
        F.when(cell(5) != ".", cell(5)).try_cast("float").alias("qual"), listed(cell(6), ";").alias("filters"), info_map(cell(7)).alias("info"), gt.alias("gt"),
        F.transform(samples, lambda c: call(c).contains("|").cast("int")).alias("ph"), number("GQ").alias("gq"), number("DP").alias("dp"),
    )
