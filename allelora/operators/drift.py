"""Schemas that drift between files: changes, and rescue-column ingestion.

The target schema is enforced on every file: fields are found under the names their file gives them, cast where
that is possible, and kept as JSON in a rescue column where it isn't or where the field is unknown. Fields
approved later are promoted by replaying the rescued values into typed columns, without reading the sources again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelora.functions.arrays import let
from allelora.operators.skew import join_shared
from allelora.session import written
from allelora.sources.headers import declarations

#: Target types and the texts that can be cast to them, one element each; "." is missing.
CASTS = {
    "bigint": r"[+-]?[0-9]{1,18}",
    "double": r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?",
    "string": r"[^,]*",
    "boolean": r"1|0|",
}


def same_text(description: Column) -> Column:
    """A description by its letters and digits, letter case ignored."""
    return F.lower(F.regexp_replace(description, r"[^\p{L}\p{N}]+", ""))


def predecessors(files: DataFrame) -> DataFrame:
    """(file_id, before): each file's predecessor in its callset by made_at; a first file has none and no row."""
    w = W.partitionBy("callset").orderBy("made_at", "file_id")
    known = files.where("callset IS NOT NULL").select("callset", "made_at", "file_id").distinct()
    return known.select("file_id", F.lag("file_id").over(w).alias("before")).where("before IS NOT NULL")


def changes(headers: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, section, field, change) of each file against its predecessor: added, removed, renamed, type_changed.

    A new ID that has the description of a gone ID of its section is a renaming. IDs without a
    description, or with one that has no letter or digit, are never renamings.
    """
    decl = written(declarations(headers).withColumn("same", same_text(F.col("description"))).drop("description"))
    pairs = written(predecessors(files))
    now = decl.join(pairs.select("file_id"), "file_id").select("file_id", "section", "id", F.struct("type", "number", "same").alias("now"))
    before = decl.withColumnRenamed("file_id", "before").join(pairs, "before").select(
        "file_id", "section", "id", F.struct("type", "number", "same").alias("was")
    )
    both = written(now.join(before, ["file_id", "section", "id"], "full"))
    gone = both.where("now IS NULL").select("file_id", "section", F.col("id").alias("old"), F.col("was.same").alias("same"), "was")
    new = both.where("was IS NULL").select("file_id", "section", "id", F.col("now.same").alias("same"), "now")
    differs = lambda a, b: ~(F.col(f"{a}.type").eqNullSafe(F.col(f"{b}.type")) & F.col(f"{a}.number").eqNullSafe(F.col(f"{b}.number")))
    on = ["file_id", "section", "same"]
    renamed = written(new.where("same != ''").join(gone.where("same != ''"), on).select("file_id", "section", "id", "old", differs("now", "was").alias("differs")))
    key = lambda df, field, change: df.select("file_id", "section", F.col(field).alias("field"), F.lit(change).alias("change"))
    parts = [
        key(both.where("now IS NOT NULL AND was IS NOT NULL").where(differs("now", "was")), "id", "type_changed"),
        key(new.join(renamed.select("file_id", "section", "id"), ["file_id", "section", "id"], "left_anti"), "id", "added"),
        key(gone.join(renamed.select("file_id", "section", "old"), ["file_id", "section", "old"], "left_anti"), "old", "removed"),
        key(renamed, "id", "renamed"),
        key(renamed.where("differs"), "id", "type_changed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def undeclared(ingested: DataFrame, headers: DataFrame, rescue: str = "rescued") -> DataFrame:
    """Keys of the rescue column that a row's file doesn't declare, in the form of ``changes``.

    ``ingested`` is the result of ``ingest`` with ``declared_only``, so every undeclared key of a row has been rescued.
    """
    # The outer form, and no condition before it: Spark would evaluate the rescue column once more for each inferred condition.
    keys = ingested.select("file_id", F.explode_outer(F.json_object_keys(rescue)).alias("field")).distinct().where("field IS NOT NULL")
    known = declarations(headers, ("INFO",)).select("file_id", F.col("id").alias("field"))
    return keys.join(known, ["file_id", "field"], "left_anti").select("file_id", F.lit("INFO").alias("section"), "field", F.lit("undeclared").alias("change"))


def consistent_names(headers: DataFrame, section: str = "INFO") -> DataFrame:
    """(file_id, names): for each file the map from its IDs to consistent ones.

    IDs of one description (by letters and digits) are one field; it is called by the ID that most files use,
    the smallest of those used equally often.
    """
    decl = declarations(headers, (section,)).withColumn("same", F.coalesce(F.nullif(same_text(F.col("description")), F.lit("")), F.concat(F.lit("\u0001"), "id")))
    used = decl.groupBy("same", "id").agg(F.count(F.lit(1)).alias("n"))
    best = used.groupBy("same").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("b")).select("same", F.col("b.id").alias("name"))
    return decl.join(best, "same").groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("names"))


def _fits(value: Column, kind: str) -> Column:
    base = kind.removeprefix("array<").removesuffix(">")
    one = rf"(?:\.|{CASTS[base]})"
    return value.rlike(rf"\A{one}(?:,{one})*\z" if kind.startswith("array<") else rf"\A{one}\z")


def _cast(value: Column, kind: str) -> Column:
    base = kind.removeprefix("array<").removesuffix(">")
    if base == "boolean":
        return value.isin(".", "1", "")
    one = lambda v: F.when(v != ".", v).try_cast(base)
    return F.transform(F.split(value, ","), one) if kind.startswith("array<") else one(value)


def ingest(variants: DataFrame, names: DataFrame, target: dict[str, str], rescue: str = "rescued", declared_only: bool = False) -> DataFrame:
    """``variants`` with one typed column per target field in place of ``info``, and the rescue column.

    ``target`` maps consistent field names to bigint, double, string, boolean (a flag) or arrays of these. What is
    unknown or doesn't fit goes to ``rescue``, a JSON object of the names and texts as the file has them (null if
    there is nothing). If two names of a row stand for one field, the smaller name that fits is taken and the
    other rescued. With ``declared_only`` fields that the row's file doesn't declare are unknown, whatever their name. A null info gives nulls. Target names must not clash with other columns of ``variants``.
    """
    clash = {c.lower() for c in variants.columns if c != "info"} & ({t.lower() for t in target} | {rescue.lower()})
    if clash:
        raise ValueError(f"columns clash with the target schema: {sorted(clash)}")
    rest = [c for c in variants.columns if c != "info"]
    joined = join_shared(variants, names.withColumnRenamed("names", "__names"), "file_id", "__names")
    named = lambda key: F.col("__names")[key] if declared_only else F.coalesce(F.col("__names")[key], key)
    entries = F.transform(F.sort_array(F.map_entries("info")), lambda e: F.struct(e["key"].alias("old"), named(e["key"]).alias("new"), F.coalesce(e["value"], F.lit(".")).alias("value")))

    def ok(x: Column) -> Column:
        known = F.lit(False)
        for kind in dict.fromkeys(target.values()):
            known = F.when(F.coalesce(x["new"], F.lit("")).isin(*[t for t, k in target.items() if k == kind]), _fits(x["value"], kind)).otherwise(known)
        return known

    marked = joined.withColumn("__all", F.transform(entries, lambda x: F.struct(x.alias("e"), ok(x).alias("ok"))))
    marked = marked.withColumn("__fit", F.transform(F.filter("__all", lambda x: x["ok"]), lambda x: x["e"]))
    at = lambda t: F.get(F.filter("__fit", lambda x: x["new"] == t), F.lit(0))
    twice = F.filter("__fit", lambda x, i: F.exists(F.slice("__fit", F.lit(1), i), lambda y: y["new"] == x["new"]))
    several = F.size(F.array_distinct(F.transform("__fit", lambda x: x["new"]))) < F.size("__fit")
    left = F.concat(F.transform(F.filter("__all", lambda x: ~x["ok"]), lambda x: x["e"]), F.when(several, twice).otherwise(F.slice("__fit", F.lit(1), F.lit(0))))
    saved = F.map_from_entries(F.transform(left, lambda x: F.struct(x["old"], x["value"])))
    return marked.select(*rest, *(_cast(at(t)["value"], k).alias(t) for t, k in target.items()), let(saved, lambda m: F.when(F.size(m) > 0, F.to_json(m))).alias(rescue))


def replay(table: DataFrame, names: DataFrame, field: str, kind: str, rescue: str = "rescued") -> DataFrame:
    """``table`` with ``field`` promoted: rescued values that fit ``kind`` move into a typed column, the others stay rescued.

    ``field`` is a consistent name; the values are found under all names that files give it.
    """
    rest = [c for c in table.columns if c != rescue]
    joined = join_shared(table, names.withColumnRenamed("names", "__names"), "file_id", "__names")
    saved = joined.withColumn("__saved", F.from_json(rescue, "map<string,string>"))
    mine = lambda k, v: (F.coalesce(F.col("__names")[k], k) == field) & _fits(v, kind)
    first = F.array_min(F.map_keys(F.map_filter("__saved", mine)))
    picked = saved.withColumn("__first", first)
    keep = F.map_filter("__saved", lambda k, v: ~k.eqNullSafe(F.col("__first")))
    return picked.select(*rest, _cast(F.col("__saved")[F.col("__first")], kind).alias(field), F.when(F.size(keep) > 0, F.to_json(keep)).alias(rescue))
