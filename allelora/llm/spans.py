"""Long exact spans shared between records, by super-k-mer partitioning.

Every text is seen as its windows of ``k`` characters. The minimiser of a window is the smallest mixed
hash among its ``m``-character substrings; consecutive windows with one minimiser form a super-k-mer, which
travels as one packed string to the bucket of that minimiser. Equal windows have equal minimisers, so
windows need to be counted only within buckets.

Scale
-----
* The first pass ships only (minimiser, id, place, length). Buckets that hold one record are dropped
  there, before any text moves; the two extreme ids of a bucket are found with map-side combining.
* Equal super-k-mers become one class before windows are laid out, so a passage that stands in a third of all
  records is one row in its bucket, however often it occurs. Only buckets with several classes lay out windows.
* A bucket is shuffled once, as packed strings. Its windows are laid out, sorted by their text and counted in place. Buckets of
  more than ``large`` windows are spread instead: their windows are counted by 128-bit hashes, with map-side combining.
* Keys that hold many rows (minimisers, classes, windows) are joined by ``join_back``; groups with the same members are
  reduced to one before pairs are made, and a large group's pairs are made in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelora.operators.skew import join_back
from allelora.session import written

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters handled at once by a task; longer texts are taken in pieces that overlap by k - 1.
PIECE = 1 << 20


#: Windows of a bucket up to which one task counts it.
LARGE = 200_000
#: Members of a group up to which one task makes its pairs.
BLOCK = 1024


def digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _substring_hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """Mixed hash of each m-character substring: polynomial modulo 2**64, from cumulative sums."""
    n = len(codes)
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    down, up = np.ones(n, np.uint64), np.ones(n, np.uint64)
    down[1:], up[1:] = inverse, BASE
    down, up = np.cumprod(down), np.cumprod(up)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down, out=sums[1:])
    return _mixed((sums[m:] - sums[:-m]) * up[: n - m + 1])


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    size, low = 1, h
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def super_kmers(texts: list[str], k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, minimiser, first window, windows) of each super-k-mer of ``texts``."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.int64)
    if len(codes) < k:
        return none, none, none, none
    low = _sliding_min(_substring_hashes(codes, m), k - m + 1)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    text = np.repeat(np.arange(len(texts)), np.maximum(lengths - k + 1, 0))
    if not len(text):
        return none, none, none, none
    firsts = np.cumsum(np.concatenate([[0], np.maximum(lengths - k + 1, 0)]))
    place = np.arange(len(text)) - firsts[text]
    at = low[begins[text] + place]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    counts = np.diff(np.concatenate([new, [len(at)]]))
    return text[new], at[new].view(np.int64), place[new], counts


def _scan(k: int, m: int):
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str]]:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for at in range(0, max(1, len(text) - k + 1), PIECE):
                yield i, at, text[at : at + PIECE + k - 1]

    def flush(held: list[tuple[int, int, str]]) -> pa.RecordBatch:
        text, h, start, n = super_kmers([t for _, _, t in held], k, m)
        ids, offsets = np.array([i for i, _, _ in held], np.int64), np.array([a for _, a, _ in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[text]), pa.array(start + offsets[text]), pa.array(n)], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch):
                held.append(piece)
                size += len(piece[2])
                if size >= PIECE:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return scan


def buckets(df: DataFrame, id_col: str, text_col: str, k: int, m: int) -> DataFrame:
    """Super-k-mers in buckets of several records: (h, c, id, start, seq), c the digest of seq; written to the shared folder."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    long = texts.where(F.length("text") >= k)
    spans = written(long.mapInArrow(_scan(k, m), "h bigint, id bigint, start bigint, n bigint"))
    counted = spans.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("n_spans"))
    shared = written(counted.where("a < b").select("h", "n_spans"))
    kept = join_back(spans, shared, "h", "n_spans").where("n_spans IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct("h", "start", "n")).alias("spans"))
    seq = F.substring("text", F.col("s.start").cast("int") + 1, F.col("s.n").cast("int") + F.lit(k - 1))
    packed = long.join(kept, "id").select("id", "text", F.explode("spans").alias("s")).select(F.col("s.h").alias("h"), "id", F.col("s.start").alias("start"), seq.alias("seq"))
    return written(packed.select("h", digest(F.col("seq")).alias("c"), "id", "start", "seq"))


class _Classes:
    """The distinct super-k-mers of ``packed``, and those in buckets of several of them: ``small`` buckets, each in one partition, and ``large`` ones."""

    def __init__(self, packed: DataFrame, k: int, large: int):
        grouped = packed.groupBy("h", "c", "seq").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("copies"))
        self.all = written(grouped.withColumn("n", F.length("seq") - F.lit(k - 1)))
        sizes = written(self.all.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("windows")).where("classes > 1"))
        sized = join_back(self.all, sizes, "h", "classes")
        self.small = sized.where(F.col("windows") <= large).repartition("h")
        self.large = None if sizes.where(F.col("windows") > large).isEmpty() else sized.where(F.col("windows") > large)
        self.k = k

    def texts(self) -> Column:
        """The windows of a class, in order."""
        return F.transform(F.sequence(F.lit(1), F.col("n")), lambda o: F.substring("seq", o, F.lit(self.k)))

    def per_class(self, rows: DataFrame, value: Column) -> DataFrame:
        """(c, copies, v): the set of ``value`` over the rows of each class; it has no more elements than the class has windows and one."""
        return written(rows.groupBy("c").agg(F.collect_set(value).alias("v")).join(self.all.select("c", "copies"), "c"))


def _shared_windows(classes: _Classes) -> DataFrame:
    """(c, o): places, from 0, of the windows of classes of one record that stand in another record too."""
    cols = ["h", "c", "a", "b"]
    w = W.partitionBy("h", "w")
    laid = classes.small.select(*cols, F.posexplode(classes.texts()).alias("o", "w"))
    found = laid.select("c", "o", "a", "b", F.min("a").over(w).alias("lo"), F.max("b").over(w).alias("hi")).where("lo < hi AND a = b").select("c", "o")
    if classes.large is None:
        return found
    spread = written(classes.large.select(*cols, F.posexplode(F.transform(classes.texts(), digest)).alias("o", "w")))
    counted = written(spread.groupBy("w").agg(F.min("a").alias("lo"), F.max("b").alias("hi"), F.count(F.lit(1)).alias("places")).where("lo < hi").select("w", "places"))
    return found.unionByName(join_back(spread.where("a = b"), counted, "w", "places").where("places IS NOT NULL").select("c", "o"))


def _window_groups(classes: _Classes) -> DataFrame:
    """(g, c): the sets of several classes that share windows, once for each set of classes of a bucket."""
    sums = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("c")), F.bit_xor(F.xxhash64(F.lit(11), "c"))]
    names = ["members", "x", "y"]
    name = lambda: F.md5(F.concat_ws(",", *(F.col(n).cast("string") for n in ("h", *names))).cast("binary")).alias("g")
    w = W.partitionBy("h", "w")
    laid = classes.small.select("h", "c", F.explode(F.array_distinct(classes.texts())).alias("w"))
    found = laid.select("h", "c", *(s.over(w).alias(n) for s, n in zip(sums, names))).where("members > 1").select("h", *names, "c").distinct().select(name(), "c")
    if classes.large is None:
        return found
    spread = written(classes.large.select("h", "c", F.explode(F.array_distinct(F.transform(classes.texts(), digest))).alias("w")))
    counted = written(spread.groupBy("w").agg(*(s.alias(n) for s, n in zip(sums, names))).where("members > 1"))
    return found.unionByName(join_back(spread, counted, "w", "members").where("members IS NOT NULL").select("h", *names, "c").distinct().select(name(), "c"))


def _pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b) of the distinct rows (g, id, size), size being the group's number of members; groups of more than ``block`` in blocks."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    placed = members.select("g", "id", blocks.alias("n"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("b"))
    one = placed.select("g", F.col("b").alias("i"), F.explode(F.sequence("b", F.col("n") - 1)).alias("j"), F.col("id").alias("x"))
    other = placed.select("g", F.explode(F.sequence(F.lit(0), "b")).alias("i"), F.col("b").alias("j"), F.col("id").alias("y"))
    met = one.join(other, ["g", "i", "j"]).where("(i < j AND x != y) OR (i = j AND x < y)")
    return met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 320, m: int = 128, large: int = LARGE) -> DataFrame:
    """Pairs of records whose texts contain a common substring of at least ``k`` characters.

    Rows (doc_a, doc_b), doc_a < doc_b, each pair once. Characters are code points. ``id_col`` must be unique.
    Null and shorter texts have no pairs; copies of a whole text are paired like any others. ``m`` and ``large`` only
    set the partitioning, not the result.
    """
    packed = buckets(df, id_col, text_col, k, m)
    classes = _Classes(packed, k, large)
    by_class = classes.all.where("a < b").select(F.md5("c").alias("g"), "c")
    per_class = classes.per_class(_window_groups(classes).unionByName(by_class), F.col("g"))
    members = written(join_back(packed.select("c", "id"), per_class, "c", "copies").select("id", F.explode("v").alias("g")).distinct())
    # Groups with the same members make the same pairs: one of them is kept.
    signed = members.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(11), "id")).alias("y"))
    kept = written(signed.where("size > 1").groupBy("size", "x", "y").agg(F.min(F.struct("g")).alias("s")).select("s.g", "size"))
    return _pairs(join_back(members, kept, "g", "size").where("size IS NOT NULL").select("g", "id", "size"))


def shared_stretches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 320, m: int = 128, large: int = LARGE) -> DataFrame:
    """The stretches of every record that stand in another record too: (id, start, n_chars), from 0, whole
    stretches without overlaps. Records without any have no rows."""
    packed = buckets(df, id_col, text_col, k, m)
    classes = _Classes(packed, k, large)
    in_class = _shared_windows(classes).groupBy("c").agg(F.sort_array(F.collect_set("o")).alias("os"))
    # Within one super-k-mer: runs of consecutive shared windows, from their first and last places.
    here = lambda cond: F.filter(F.transform("os", lambda o, i: F.when(cond(o, i), o)), lambda o: o.isNotNull())
    firsts = here(lambda o, i: (i == 0) | (F.get("os", i - 1) < o - 1))
    lasts = here(lambda o, i: F.coalesce(F.get("os", i + 1) > o + 1, F.lit(True)))
    runs = in_class.select("c", F.inline(F.zip_with(firsts, lasts, lambda x, y: F.struct(x.cast("bigint").alias("o"), y.cast("bigint").alias("e")))))
    whole = classes.all.where("a < b").select("c", F.lit(0).cast("bigint").alias("o"), (F.col("n") - 1).cast("bigint").alias("e"))
    per_class = classes.per_class(runs.unionByName(whole), F.struct("o", "e"))
    placed = join_back(packed.select("c", "id", "start"), per_class, "c", "copies").select("id", "start", F.explode("v").alias("v"))
    found = placed.select("id", (F.col("start") + F.col("v.o")).alias("b"), (F.col("start") + F.col("v.e") + k).alias("e"))
    w = W.partitionBy("id").orderBy("b", "e")
    far = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    numbered = found.withColumn("new", (far.isNull() | (far < F.col("b"))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("b").alias("start"), F.max("e").alias("end")).select(F.col("id").alias(id_col), "start", (F.col("end") - F.col("start")).alias("n_chars"))
