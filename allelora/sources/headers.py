"""Header lines: declarations of INFO, FORMAT and FILTER fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = r'"(?:\\.|[^"\\])*"'


def attribute(value: Column, name: str) -> Column:
    """An attribute of a ``<ID=...,Number=...>`` value, null if it isn't there; quoted text is never taken for attributes."""
    bare = F.regexp_replace(value, QUOTED, '""')
    found = F.regexp_extract(bare, rf"[<,]\s*{name}\s*=\s*([^,>]*)", 1)
    return F.when(bare.rlike(rf"[<,]\s*{name}\s*="), F.trim(found))


def quoted_attribute(value: Column, name: str) -> Column:
    """A quoted attribute's text without its quotes, else the unquoted one."""
    pattern = rf'[<,]\s*{name}\s*=\s*"((?:\\.|[^"\\])*)"'
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1)).otherwise(attribute(value, name))


def with_attributes(headers: DataFrame) -> DataFrame:
    """Header lines with columns id, type, number and description (null where a line has none)."""
    v = F.col("value")
    return headers.withColumns(
        {"id": attribute(v, "ID"), "type": attribute(v, "Type"), "number": attribute(v, "Number"), "description": quoted_attribute(v, "Description")}
    )


def declarations(headers: DataFrame, sections: tuple[str, ...] = ("INFO", "FORMAT")) -> DataFrame:
    """(file_id, section, id, type, number, description): the first declaration of each ID of a file."""
    lines = with_attributes(headers.where(F.col("key").isin(*sections))).where("id IS NOT NULL")
    first = F.min(F.struct("seq", "type", "number", "description")).alias("f")
    return lines.groupBy("file_id", F.col("key").alias("section"), "id").agg(first).select(
        "file_id", "section", "id", "f.type", "f.number", "f.description"
    )


def subfield(value: Column, name: str) -> Column:
    """Value of a sub-field of a header value (quotes kept), empty if absent."""
    return F.regexp_extract(value, rf'[<,]\s*{name}\s*=\s*({QUOTED}|[^,>]*)', 1)


def without_subfield(value: Column, name: str) -> Column:
    """A header value without one of its sub-fields."""
    one = rf'\s*{name}\s*=\s*(?:{QUOTED}|[^,>]*)'
    return F.regexp_replace(F.regexp_replace(value, rf"<{one},?", "<"), rf",{one}", "")


def with_file_date(headers: DataFrame) -> DataFrame:
    """Header lines with today's fileDate, where they have one."""
    today = F.date_format(F.current_date(), "yyyyMMdd")
    return headers.withColumn("value", F.when(F.col("key") == "fileDate", today).otherwise(F.col("value")))


def with_declared(headers: DataFrame, lines: dict[str, str]) -> DataFrame:
    """Header lines with INFO declarations (ID to the whole value) added after the others, those that are missing."""
    known = {r["id"] for r in with_attributes(headers.where("key = 'INFO'")).select("id").distinct().collect()}
    top = headers.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
    new = [(top + 1 + i, "INFO", value) for i, (key, value) in enumerate((k, v) for k, v in lines.items() if k not in known)]
    added = headers.sparkSession.createDataFrame(new, "seq bigint, key string, value string")
    return headers.select(F.col("seq").cast("bigint").alias("seq"), "key", "value").unionByName(added)


def union(headers: list[DataFrame]) -> DataFrame:
    """Union of the headers of several files: declarations once for each ID (first file's), other lines once for each text."""
    all_lines = None
    for n, h in enumerate(headers):
        part = h.select(F.lit(n).alias("ord"), "seq", "key", "value")
        all_lines = part if all_lines is None else all_lines.unionByName(part)
    same = F.coalesce(F.when(F.col("key").isin("INFO", "FORMAT", "FILTER", "contig"), attribute(F.col("value"), "ID")), F.col("value"))
    first = all_lines.groupBy("key", same.alias("same")).agg(F.min(F.struct("ord", "seq", "value")).alias("f"))
    return first.select("f.ord", "f.seq", "key", "f.value")
