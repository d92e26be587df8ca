"""Operators for keys that hold most of the records.

``range_states`` spreads rows over range partitions of a composite key, so that a heavy key is split over
several partitions, keeps running values per partition, and stitches the states at the partitions'
boundaries. ``join_back`` joins rows with one row per key, heavy keys by broadcast of a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelora.session import cut, written


def range_partitioned(df: DataFrame, key: str, order: list[str], partitions: int | None = None, sums: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``df`` in range partitions of (key, order...), sorted, with the partition's number ``__part``, the row's number
    ``__at`` among the rows of its key in that partition, from 0, and for each of ``sums`` (bigint columns without
    nulls) ``__at_<name>``, its sum over the rows of its key before it in that partition.

    The bounds are quantiles of a sample that Spark draws from the composite key, so a heavy key gets as many
    partitions as its share of rows. ``order`` should end with a unique column; else equal keys stay together.
    Nulls come first. Written to the shared folder: the bounds are drawn once.
    """
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    place, places = ranged.columns.index(key), [ranged.columns.index(s) for s in sums]
    added = ["__at", *(f"__at_{s}" for s in sums)]
    schema = ranged.select("*", F.lit(0).alias("__part"), *(F.lit(0).cast("bigint").alias(a) for a in added)).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, True
        carried = np.zeros(len(added), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.ones(batch.num_rows, np.int64), *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in places)]
            before = [np.cumsum(v) - v for v in values]
            totals = np.array([b[-1] + v[-1] for b, v in zip(before, values)])
            runs = pc.run_end_encode(batch.column(place))
            ends = np.array(runs.run_ends.to_pylist())
            begins = np.concatenate([[0], ends[:-1]])
            keys = runs.values.to_pylist()
            out = []
            for c, b in enumerate(before):
                base = b[begins].copy()
                if not first and keys[0] == last:
                    base[0] -= carried[c]
                out.append(pa.array(b - np.repeat(base, ends - begins), pa.int64()))
            start = begins[-1]
            continues = len(keys) == 1 and not first and keys[0] == last
            carried = totals - np.array([b[start] for b in before]) + (carried if continues else 0)
            first, last = False, keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), *out], names=[*batch.schema.names, "__part", *added])

    return cut(ranged.mapInArrow(number, schema))


def states(ranged: DataFrame, key: str, **values: Column) -> DataFrame:
    """Partial states of the result of ``range_partitioned``: one row for each partition and key in it."""
    return ranged.groupBy("__part", key).agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in values.items()))


def running(df: DataFrame, key: str, order: list[str], sums: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank``, the row's number within its key by ``order``, from 0, and ``before_<name>``, the sum of each of
    ``sums`` over the rows before it, without sending a key to one task.

    Only keys that cross a partition boundary need stitching; those are fewer than the partitions, so
    the offsets that are broadcast have that bound. Null keys are a key of their own; an empty table stays empty.
    """
    ranged = range_partitioned(df, key, order, partitions, sums)
    names = ["n", *(f"s_{s}" for s in sums)]
    parts = states(ranged, key, **{f"s_{s}": F.sum(s) for s in sums})
    crossing = parts.groupBy(key).agg(F.collect_list(F.struct(F.col("__part").alias("part"), *names)).alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1")
    total = lambda x, name: F.aggregate(F.filter("s", lambda y: y["part"] < x["part"]), F.lit(0).cast("bigint"), lambda a, y: a + y[name]).alias(name)
    before = F.transform("s", lambda x: F.struct(x["part"].alias("part"), *(total(x, name) for name in names)))
    offsets = crossing.select(F.col(key).alias("__key"), F.explode(before).alias("__o"))
    joined = ranged.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__o.part")), "left")
    stitched = {"rank": F.col("__at") + F.coalesce("__o.n", F.lit(0))} | {f"before_{s}": F.col(f"__at_{s}") + F.coalesce(f"__o.s_{s}", F.lit(0)) for s in sums}
    return joined.withColumns(stitched).select(*df.columns, *stitched)


def key_summary(df: DataFrame, key: str, order: list[str], partitions: int | None = None, **values: Column) -> DataFrame:
    """One row per key: n and the stitched ``values``. Each value is an aggregate of sums, minima or maxima, which is
    taken per partition and stitched by the same function; name them sum_*, min_* or max_*."""
    parts = states(range_partitioned(df, key, order, partitions), key, **values)
    stitch = {"sum": F.sum, "min": F.min, "max": F.max}
    return parts.groupBy(key).agg(F.sum("n").alias("n"), *(stitch[k.split("_")[0]](k).alias(k) for k in values))


def join_back(rows: DataFrame, per_key: DataFrame, key: str, count: str, heavy: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``per_key`` (one row per non-null key, ``count`` of its rows in ``rows``).

    Keys with more than a ``heavy``-th of all rows are at most ``heavy`` keys and are joined by broadcast; their rows are
    spread over the partitions instead of meeting in one. All others are joined by shuffle.
    """
    total = per_key.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_heavy = F.col(count) * heavy > F.lit(total)
    rest = [c for c in per_key.columns if c != key]
    hot = F.broadcast(per_key.where(is_heavy).select(F.col(key).alias("__hot"), F.struct(*rest).alias("__h")))
    cold = per_key.where(~is_heavy).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("__cold"), F.struct(*rest).alias("__c"))
    spread = F.concat(F.lit("s"), F.monotonically_increasing_id().cast("string"))
    one = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn(
        "__cold", F.when(F.col("__h").isNotNull() | F.col(key).isNull(), spread).otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))
    )
    both = one.join(cold, "__cold", "left").withColumn("__v", F.coalesce("__h", "__c"))
    return both.select(*rows.columns, *(F.col("__v")[c].alias(c) for c in rest))


def join_shared(rows: DataFrame, per_key: DataFrame, key: str, value: str, max_keys: int = 200_000, max_values: int = 1_000) -> DataFrame:
    """Left join of ``rows`` with ``per_key`` (one row per non-null ``key``), where many keys have the same ``value``, a map.

    Up to ``max_keys`` keys and ``max_values`` different maps, counted first, both are broadcast, a key with its map's hash and each map once, so ``rows``
    aren't shuffled; beyond that they are joined by ``join_back``. The result is the same.
    """
    text = F.to_json(F.sort_array(F.map_entries(value)))
    known = written(per_key.select(F.col(key).alias("__key"), F.col(value).alias("__value"), F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(7), text).alias("y")).alias("__hash")))
    keys, values = known.agg(F.count(F.lit(1)), F.count_distinct("__hash")).first()
    if keys <= max_keys and values <= max_values:
        maps = known.groupBy("__hash").agg(F.first("__value").alias(value))
        hashes = known.select("__key", F.col("__hash").alias("__of"))
        named = rows.join(F.broadcast(hashes), F.col(key) == F.col("__key"), "left")
        return named.join(F.broadcast(maps), F.col("__of") == F.col("__hash"), "left").select(*rows.columns, value)
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    counted = written(counts.join(known.select(F.col("__key").alias(key), F.col("__value").alias(value)), key))
    return join_back(rows, counted, key, "__n").drop("__n")
