"""Duplicates hidden by formatting differences.

Each field is brought into a canonical form (characters, case, whitespace, punctuation, order of parts), the
forms are hashed to 128 bits, and copies are counted per hash with map-side combining. The smallest and largest value of
a second hash are kept: where they differ, two records collided and that hash is counted by text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.operators.skew import join_back
from allelora.session import written

OTHER = r"[^\p{L}\p{N}]+"
#: Between info pairs: semicolon, bar, ampersand or line break; a comma or blank only before "key =".
PAIR_ENDS = r"[;|&\r\n]|[,\s\x{A0}](?=[\s\x{A0}]*[\p{L}_][\p{L}\p{N}_]*[\s\x{A0}]*=)"


def plain(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(c, OTHER, ""))


def alleles(c: Column) -> Column:
    """List of alleles, order kept: each run of letters, or ``*``; anything else only separates."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\*"), F.lit(0)), ",")


def pair_set(c: Column) -> Column:
    """Sorted set of key=value pairs; in values a full stop between digits stays."""
    def value(v: Column) -> Column:
        dotted = F.regexp_replace(v, r"(?<=[0-9])\.(?=[0-9])", "\u0001")
        return F.translate(F.lower(F.regexp_replace(dotted, "[^\\p{L}\\p{N}\u0001]+", "")), "\u0001", ".")

    pairs = F.transform(
        F.split(c, PAIR_ENDS),
        lambda p: F.concat(plain(F.substring_index(p, "=", 1)), F.when(p.contains("="), F.concat(F.lit("="), value(F.substring(p, F.instr(p, "=") + 1, F.length(p))))).otherwise("")),
    )
    return F.array_join(F.sort_array(F.array_distinct(F.filter(pairs, lambda p: p != ""))), ";")


FORMS = {"plain": plain, "alleles": alleles, "pairs": pair_set}


def canonical(fields: dict[str, str]) -> Column:
    """One text for the canonical forms of ``fields`` (column to form); null fields are marked as such."""
    return F.concat_ws("\u001f", *(F.coalesce(F.concat(F.lit("="), FORMS[form](F.col(c))), F.lit("~")) for c, form in fields.items()))


def collapse(df: DataFrame, id_col: str, fields: dict[str, str], digest=F.md5) -> DataFrame:
    """One row for each group of equal records: (first_id, copies), first_id being its smallest id.

    Null equals null only. ``id_col`` must be unique; other columns of ``df`` are ignored. ``digest`` gives a hexadecimal hash of the canonical
    form; hashes that different forms share are split by text, exactly.
    """
    hashed, groups = _grouped(df, id_col, fields, digest)
    return groups.select("first_id", "copies")


def later_copies(df: DataFrame, id_col: str, fields: dict[str, str], digest=F.md5) -> DataFrame:
    """(first_id, id) of each record that equals an earlier one: the smallest id of its group and its own."""
    hashed, groups = _grouped(df, id_col, fields, digest)
    several = groups.where("copies > 1")
    return join_back(hashed, several, "hash", "copies").where(F.col("id") > F.col("first_id")).select("first_id", "id")


def _grouped(df: DataFrame, id_col: str, fields: dict[str, str], digest) -> tuple[DataFrame, DataFrame]:
    """((id, hash) of each record, (hash, first_id, copies) of each group).

    Texts are made canonical once; from then on rows have fixed width. ``check``, a second hash, shows where two texts share a hash: only their
    rows are read again, and their hash gets the text's own hash, and its place among the texts of that hash, added.
    """
    form = canonical(fields)
    hash_of = lambda text: F.unhex(digest(text.cast("binary")))
    texts = df.select(F.col(id_col).alias("id"), form.alias("text"))
    hashed = written(texts.select("id", hash_of(F.col("text")).alias("hash"), F.xxhash64("text").alias("check")))
    counted = written(hashed.groupBy("hash").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    shared = counted.where("low != high").select("hash")
    clean = counted.where("low = high").select("hash", "first_id", "copies")
    if shared.isEmpty():
        return hashed.select("id", "hash"), clean
    rows = texts.withColumn("hash", hash_of(F.col("text"))).join(shared, "hash", "left_semi")
    per_text = rows.groupBy("hash", "text").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # Within a hash the smallest ids of two texts differ, so hash and smallest id name a text.
    own = lambda: F.concat("hash", F.encode(F.col("first_id").cast("string"), "UTF-8"))
    named = join_back(rows.withColumn("key", F.concat("hash", F.encode("text", "UTF-8"))), per_text.withColumn("key", F.concat("hash", F.encode("text", "UTF-8"))).select("key", "first_id", "copies"), "key", "copies")
    apart = named.select("id", own().alias("hash"))
    alone = hashed.join(shared, "hash", "left_anti").select("id", "hash")
    return alone.unionByName(apart), clean.unionByName(per_text.select(own().alias("hash"), "first_id", "copies"))
