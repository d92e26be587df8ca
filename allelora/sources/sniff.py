"""Which format a path holds, by its first bytes."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession


def sniff(spark: SparkSession, path: str) -> str:
    """parquet for a folder with ``variants`` in it, bcf or vcf for files, compressed or not. Raises ValueError for anything else."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jvm.org.apache.hadoop.fs.Path(place, "variants")):
        return "parquet"
    found = files.globStatus(place)
    if not found:
        raise ValueError(f"there is nothing at {path}")
    first = found[0].getPath()
    if files.getFileStatus(first).isDirectory():
        first = sorted(str(f.getPath()) for f in files.listStatus(first) if not f.getPath().getName().startswith(("_", ".")))[0]
    rows = spark.read.format("binaryFile").load(str(first)).selectExpr("substring(content, 1, 65536) AS head").collect()
    head = bytes(rows[0]["head"]) if rows else b""
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, 64)
    if head[:3] == b"BCF":
        return "bcf"
    if head[:2] == b"##" or head[:6] == b"#CHROM":
        return "vcf"
    raise ValueError(f"neither VCF nor BCF: {path}")
