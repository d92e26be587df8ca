"""Evaluation texts leaking into a corpus: Wu-Manber multi-pattern search.

The patterns are all runs of ``words`` consecutive words of the evaluation items. A word is a maximal run of
ASCII letters and digits, letter case ignored; all else only separates. Texts are brought into the
form " w1 w2 ... wn " and searched for " p1 ... p12 ", so a match is a match of whole words.

The search is one pass over the corpus without a shuffle of texts: a table over hashed 4-byte blocks says how
far a position may be skipped; where it says zero, the hash bucket of the pattern's suffix block selects
the patterns to compare directly. Cursors of many text segments advance together in numpy.
Patterns are made and spread over blocks of about ``block_chars`` bytes by Spark, as files in the shared folder. A task reads the blocks there, one
at a time, and searches a bounded stretch of its texts for each; so the corpus is read once, and neither driver nor task holds all items.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelora.session import written

WIDTH = 4
SLOTS = 1 << 18
SEGMENT = 2048
#: Bytes of text that a task searches at once for each block.
STRETCH = 1 << 25
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """" w1 w2 ... wn ", in lower case; bytes of other characters only separate."""
    return b" " + b" ".join(text.encode("utf-8", "replace").translate(_KEEP).split()) + b" "


class Searcher:
    """Wu-Manber tables for patterns of any lengths of at least WIDTH bytes."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.least = min(map(len, patterns))
        self.most = max(map(len, patterns))
        self.shift = np.full(SLOTS, self.least - WIDTH + 1, np.int64)
        ends: dict[int, list[int]] = defaultdict(list)
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(len(patterns), self.least)
        for end in range(WIDTH, self.least + 1):
            slots = self._slot(*(heads[:, end - WIDTH + j] for j in range(WIDTH)))
            np.minimum.at(self.shift, slots, self.least - end)
            if end == self.least:
                for i, s in enumerate(slots.tolist()):
                    ends[s].append(i)
        self.ends = dict(ends)

    @staticmethod
    def _slot(a, b, c, d) -> np.ndarray:
        key = a.astype(np.uint32) | b.astype(np.uint32) << np.uint32(8) | c.astype(np.uint32) << np.uint32(16) | d.astype(np.uint32) << np.uint32(24)
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(index of text, index of pattern) of every occurrence, repeated ones too."""
        buffer = b"".join(texts)
        data = np.frombuffer(buffer, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        pieces = np.maximum(1, -(-(ends - begins) // SEGMENT))
        text = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[text] + nth * SEGMENT
        # A segment owns the occurrences that begin in it; ``at`` is where the pattern's head would end.
        last = np.minimum(np.minimum(start + SEGMENT - 1, ends[text] - 1) + self.least, ends[text])
        at = start + self.least
        live = np.flatnonzero(at <= last)
        while len(live):
            x = at[live]
            slots = self._slot(data[x - 4], data[x - 3], data[x - 2], data[x - 1])
            skip = self.shift[slots]
            for j in np.flatnonzero(skip == 0).tolist():
                begin = int(x[j]) - self.least
                owner = int(text[live[j]])
                for p in self.ends.get(int(slots[j]), ()):
                    if buffer.startswith(self.patterns[p], begin) and begin + len(self.patterns[p]) <= ends[owner]:
                        yield owner, p
            at[live] = x + np.maximum(skip, 1)
            live = live[at[live] <= last[live]]


def _runs(words: int):
    """Each run of ``words`` words of (item, text) rows as a pattern, with the pattern's 128-bit digest as its name."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = normal(text).split()
                found = {b" " + b" ".join(tokens[i : i + words]) + b" " for i in range(len(tokens) - words + 1)}
                rows += [(item, hashlib.md5(p).digest(), p) for p in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["item", "passage", "pattern"])

    return runs


@lru_cache(maxsize=2)
def _searcher(path: str) -> tuple[list[bytes], Searcher | None]:
    """Names and tables of one block's patterns. The last two blocks stay with the worker, so it builds few blocks once only."""
    if path.startswith("file:"):
        path = "file://" + path.removeprefix("file:").removeprefix("//")
    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    names: list[bytes] = []
    patterns: list[bytes] = []
    for info in system.get_file_info(fs.FileSelector(place)):
        if info.is_file and not info.base_name.startswith(("_", ".")):
            table = pq.read_table(info.path, columns=["passage", "pattern"], filesystem=system, partitioning=None)
            names += table["passage"].to_pylist()
            patterns += table["pattern"].to_pylist()
    return names, Searcher(patterns) if patterns else None


def _search(blocks: list[str]):
    schema = pa.schema([("doc", pa.int64()), ("passage", pa.binary())])

    def flush(ids: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            names, searcher = _searcher(block)
            rows = sorted({(ids[i], names[p]) for i, p in searcher.search(texts)}) if searcher else []
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                texts.append(normal(text))
                size += len(texts[-1])
                if size >= STRETCH:
                    yield from flush(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from flush(ids, texts)

    return search


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 12,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """Every (document, item) where at least ``words`` consecutive words of the item stand consecutively in
    the document: rows (doc_id, item_id, n_passages), n_passages the number of different runs of ``words``
    words of the item that occur there.

    Null and empty texts, and items of fewer words, match nothing. Repeated documents or items give one row. ``block_chars`` bounds
    what a task holds, not the result. The shared folder must be one that pyarrow can open.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    owners = written(known.mapInArrow(_runs(words), "item bigint, passage binary, pattern binary").groupBy("item", "passage", "pattern").agg(F.lit(0).alias("one")).drop("one"))
    size = owners.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    count = -(-size // block_chars)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.length("text") >= 2 * words - 1)
    blocked = owners.groupBy("passage", "pattern").agg(F.lit(0).alias("one")).select("passage", "pattern", F.pmod(F.xxhash64("pattern"), F.lit(max(1, count))).alias("block"))
    # A block's patterns are in one folder, whichever tasks wrote them.
    tables = written(blocked.repartition("block"), "block")
    folders = sorted({unquote(f.rsplit("/", 1)[0]) for f in tables.inputFiles()}) if count else []
    found = texts.mapInArrow(_search(folders), "doc bigint, passage binary") if folders else spark.createDataFrame([], "doc bigint, passage binary")
    # A stretch of one document ends in one task, but a document may be there twice.
    hits = found.groupBy("doc", "passage").agg(F.lit(0).alias("one"))
    return hits.join(owners.select("item", "passage"), "passage").groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_passages")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_passages")
