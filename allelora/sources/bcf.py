"""BCF2, the binary form of VCF (as published with the VCF specification): decoding into the variant schema and encoding.

A file is read by one task, decompressed in a stream and handed on in batches, so memory follows the batch, not the file.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"BCF\x02\x02"
EOV, MISSING = -2147483647, -1
SCHEMA = (
    "file string, row_idx bigint, chrom string, pos int, id string, ref string, alts array<string>, qual float, filters array<string>, "
    "info map<string,string>, format array<string>, gt array<int>, ph array<int>, undeclared map<string,array<string>>"
)
_INTS = {1: (np.dtype("<i1"), -128), 2: (np.dtype("<i2"), -32768), 3: (np.dtype("<i4"), -2147483648)}
_MISSING_FLOAT, _END_FLOAT = 0x7F800001, 0x7F800002


class Header:
    """Dictionaries of a header: strings (FILTER, INFO, FORMAT share one, PASS is 0) and contigs; IDX pins a place."""

    def __init__(self, text: str):
        self.text = text
        self.strings: dict[int, str] = {0: "PASS"}
        self.contigs: dict[int, str] = {}
        self.samples: list[str] = []
        for line in text.rstrip("\0").splitlines():
            found = re.match(r"##(INFO|FORMAT|FILTER|contig)=<(.*)>", line)
            if found:
                bare = re.sub(r'"(?:\\.|[^"\\])*"', '""', found[2])
                attrs = dict(re.findall(r"(?:^|,)\s*(\w+)=([^,]*)", bare))
                table = self.contigs if found[1] == "contig" else self.strings
                if "ID" in attrs and attrs["ID"] not in table.values():
                    table[int(attrs["IDX"]) if "IDX" in attrs else max(table, default=-1) + 1] = attrs["ID"]
            elif line.startswith("#CHROM"):
                self.samples = line.split("\t")[9:]


def _typed(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, place of the values)."""
    kind, n, at = data[at] & 15, data[at] >> 4, at + 1
    if n == 15:
        (n, *_), at = _values(data, at)
    return kind, n, at


def _values(data: bytes, at: int) -> tuple[list, int]:
    """Values at ``at``: ints with None for missing and without end-of-vector marks, floats alike, or one text."""
    kind, n, at = _typed(data, at)
    if kind in _INTS:
        dtype, low = _INTS[kind]
        raw = np.frombuffer(data, dtype, n, at).astype(np.int64)
        return [None if v == low else int(v) for v in raw.tolist() if v != low + 1], at + n * dtype.itemsize
    if kind == 5:
        bits, raw = np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<f4", n, at)
        return [None if b == _MISSING_FLOAT else float(v) for b, v in zip(bits.tolist(), raw.tolist()) if b != _END_FLOAT], at + 4 * n
    if kind == 7:
        return [data[at : at + n].decode("utf-8", "replace").rstrip("\0")], at + n
    if kind == 0:
        return [], at
    raise ValueError(f"unknown type {kind}")


def _text(values: list) -> str:
    return ",".join("." if v is None else v if isinstance(v, str) else "%g" % v if isinstance(v, float) else str(v) for v in values) or "."


def _genotypes(data: bytes, kind: int, per: int, n: int, at: int) -> tuple[list[int], list[int]]:
    dtype, low = _INTS[kind]
    raw = np.frombuffer(data, dtype, per * n, at).astype(np.int64).reshape(n, per)
    end = raw == low + 1
    gt = np.where(end, EOV, np.where(raw == low, MISSING, (raw >> 1) - 1))
    ph = np.where(end[:, 1:], 0, raw[:, 1:] & 1)
    return gt.ravel().tolist(), ph.ravel().tolist()


def record(shared: bytes, indiv: bytes, header: Header) -> tuple:
    """A record's fields in the order of SCHEMA, from chrom on."""
    chrom, pos, _, qual_bits, counts, sizes = struct.unpack_from("<iiiIII", shared)
    qual = None if qual_bits == _MISSING_FLOAT else struct.unpack_from("<f", shared, 12)[0]
    names, at = _values(shared, 24)
    alleles = []
    for _ in range(counts >> 16):
        allele, at = _values(shared, at)
        alleles.append(allele[0] if allele else "")
    filters, at = _values(shared, at)
    info: dict[str, str] = {}
    for _ in range(counts & 0xFFFF):
        (key,), at = _values(shared, at)
        value, at = _values(shared, at)
        info.setdefault(header.strings[key], _text(value))
    gt = ph = None
    keys, texts = [], {}
    n_samples, at = sizes & 0xFFFFFF, 0
    for _ in range(sizes >> 24):
        (key,), at = _values(indiv, at)
        kind, per, at = _typed(indiv, at)
        width = _INTS[kind][0].itemsize if kind in _INTS else 4 if kind == 5 else 1
        name = header.strings[key]
        keys.append(name)
        if name == "GT" and kind in _INTS:
            gt, ph = _genotypes(indiv, kind, per, n_samples, at)
        else:
            texts[name] = _sample_texts(indiv, kind, per, n_samples, at)
        at += width * per * n_samples
    return header.contigs[chrom], pos + 1, (names or ["."])[0] or ".", alleles[0] if alleles else None, alleles[1:], qual, [header.strings[f] for f in filters], info, keys, gt, ph, texts or None


def _sample_texts(data: bytes, kind: int, per: int, n: int, at: int) -> list[str]:
    """Each sample's text of a field, as VCF has it."""
    if kind == 7:
        return [data[at + i * per : at + (i + 1) * per].decode("utf-8", "replace").rstrip("\0") or "." for i in range(n)]
    if kind == 5:
        bits = np.frombuffer(data, "<u4", per * n, at).reshape(n, per).tolist()
        values = np.frombuffer(data, "<f4", per * n, at).reshape(n, per).tolist()
        return [_text([None if b == _MISSING_FLOAT else float(v) for b, v in zip(bs, vs) if b != _END_FLOAT]) for bs, vs in zip(bits, values)]
    dtype, low = _INTS[kind]
    raw = np.frombuffer(data, dtype, per * n, at).astype(np.int64).reshape(n, per).tolist()
    return [_text([None if v == low else v for v in row if v != low + 1]) for row in raw]


def _exact(stream: io.BufferedIOBase, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError("the file ends within a record")
    return data


def decode(data: bytes) -> Iterator[tuple]:
    """Records of a whole file's bytes, block-compressed or plain. Raises ValueError on other or cut-off data."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    if stream.read(5) != MAGIC:
        raise ValueError("not BCF version 2")
    header = Header(_exact(stream, struct.unpack("<I", _exact(stream, 4))[0]).decode("utf-8", "replace"))
    while head := stream.read(8):
        if len(head) < 8:
            raise ValueError("the file ends within a record")
        n_shared, n_indiv = struct.unpack("<II", head)
        yield record(_exact(stream, n_shared), _exact(stream, n_indiv), header)


def read(spark: SparkSession, path: str, batch: int = 2000) -> DataFrame:
    """Records of BCF files, with file and row_idx (from 0 in each file)."""
    names = [c.split()[0] for c in re.split(r",\s+", SCHEMA)]  # no comma with a blank stands within a type

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                held = []
                for i, r in enumerate(decode(data)):
                    held.append((name, i, *r))
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=names)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, SCHEMA)


def header_rows(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, ...]]:
    """((seq, key, value) header lines, sample IDs) of a file, or of the first of several."""

    def head(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                if stream.read(5) != MAGIC:
                    raise ValueError("not BCF version 2")
                text = _exact(stream, struct.unpack("<I", _exact(stream, 4))[0]).decode("utf-8", "replace").rstrip("\0")
                yield pd.DataFrame({"file": [name], "text": [text]})

    row = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(head, "file string, text string").orderBy("file").first()
    if row is None:
        raise ValueError(f"there is no file at {path}")
    lines = [x[2:].partition("=") for x in row["text"].splitlines() if x.startswith("##")]
    frame = spark.createDataFrame([(i, k, v) for i, (k, _, v) in enumerate(lines)], "seq bigint, key string, value string")
    return frame, tuple(Header(row["text"]).samples)


def _put(values: list, kind: int) -> bytes:
    if kind == 7:
        body, n = values[0].encode(), len(values[0].encode())
    elif kind == 5:
        body, n = b"".join(struct.pack("<I", _MISSING_FLOAT) if v is None else struct.pack("<f", v) for v in values), len(values)
    else:
        body, n = np.array([-2147483648 if v is None else v for v in values], "<i4").tobytes(), len(values)
    if n < 15:
        return bytes([n << 4 | kind]) + body
    return bytes([15 << 4 | kind]) + _put([n], 3) + body


def encode(text: str, rows: list[dict], ploidy: int = 2) -> bytes:
    """A block-compressed file of ``rows`` (dicts in the variant schema). Every key must be declared in the header ``text``."""
    header = Header(text)
    strings, contigs = {v: k for k, v in header.strings.items()}, {v: k for k, v in header.contigs.items()}
    kinds = {m[1]: m[2] for m in re.finditer(r"##INFO=<[^>]*?ID=([^,>]*)[^>]*?Type=(\w+)", text)}
    raw = text.encode() + b"\0"
    out = [MAGIC, struct.pack("<I", len(raw)), raw]
    for r in rows:
        info = r["info"] or {}
        for key in [*info, *r["filters"]]:
            if key not in strings:
                raise ValueError(f"not declared: {key}")
        alleles = [r["ref"], *r["alts"]]
        rlen = max(map(len, alleles))
        body = [_put([r["id"] or "."], 7), *(_put([a], 7) for a in alleles), _put([strings[f] for f in r["filters"]], 3)]
        for key, value in info.items():
            body.append(_put([strings[key]], 3))
            kind = kinds.get(key)
            if kind == "Integer":
                body.append(_put([None if v == "." else int(v) for v in value.split(",")], 3))
            elif kind == "Float":
                body.append(_put([None if v == "." else float(v) for v in value.split(",")], 5))
            else:
                body.append(b"\0" if kind == "Flag" else _put([value], 7))
        indiv = b""
        if r["gt"] is not None:
            ph = r["ph"] or [0] * (len(header.samples) * (ploidy - 1))
            codes = [-2147483647 if a == EOV else (a + 1) << 1 | (ph[i // ploidy * (ploidy - 1) + i % ploidy - 1] if i % ploidy else 0) for i, a in enumerate(r["gt"])]
            indiv = _put([strings["GT"]], 3) + bytes([ploidy << 4 | 3]) + np.array(codes, "<i4").tobytes()
        qual = struct.pack("<I", _MISSING_FLOAT) if r["qual"] is None else struct.pack("<f", r["qual"])
        fixed = struct.pack("<iii", contigs[r["chrom"]], r["pos"] - 1, rlen) + qual + struct.pack("<II", len(alleles) << 16 | len(info), (1 if indiv else 0) << 24 | len(header.samples))
        shared = fixed + b"".join(body)
        out += [struct.pack("<II", len(shared), len(indiv)), shared, indiv]
    return _blocks(b"".join(out))


def _blocks(data: bytes, size: int = 65_280) -> bytes:
    """``data`` as gzip members of at most 64 KiB that tell their length, and the empty one that ends such a file, so that readers can find blocks."""
    out = []
    for at in [*range(0, len(data), size), None]:
        piece = b"" if at is None else data[at : at + size]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(piece) + packer.flush()
        head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)
