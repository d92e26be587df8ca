"""Command line: python -m allelora COMMAND ... Data are read as VCF, BCF or a Parquet folder, told apart by their content.

export and import write VCF text parts (-O vcf) or a Parquet folder (-O parquet); statistics are printed as tab-separated lines.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelora.dataset import Dataset
from allelora.operators import order, stats
from allelora.session import get_spark


def _words(value: str) -> tuple[str, ...]:
    return tuple(x for x in value.split(",") if x)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="allelora", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *files: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=what)
        for f in files:
            one.add_argument(f.rstrip("+"), nargs="+" if f.endswith("+") else None)
        return one

    for name in ("export", "import"):
        p = command(name, "select, filter, subset and write", "input", "output")
        p.add_argument("-O", "--output-format", choices=("vcf", "parquet"), default="vcf" if name == "export" else "parquet")
        p.add_argument("-r", "--regions", type=_words, default=(), help="chr[:beg[-end]], several by commas")
        p.add_argument("-R", "--regions-file", help="lines of chrom, start and end by tabs")
        p.add_argument("-p", "--bounding-point", choices=("beg", "any", "all", "end"), default="beg")
        p.add_argument("-c", "--slice", help="beg:end, rows from 0, end excluded")
        p.add_argument("-f", "--filter", default="", help="expression over INFO, QUAL and FILTER")
        p.add_argument("-i", "--sample-ids", type=_words)
        p.add_argument("-I", "--sample-ids-file", help="one ID a line")
        p.add_argument("-m", "--info-fields", type=_words)
        p.add_argument("--generate-info", type=_words, default=(), help="of AC, AN, AF, MAC and MAF")
        p.add_argument("--phasing", choices=("none", "partial", "full"))
        p.add_argument("--sites-only", action="store_true")
        p.add_argument("-b", "--block-size", type=int, default=0, help="most records of an output file")
    p = command("head", "header lines or sample IDs", "input")
    p.add_argument("-i", "--sample-ids", action="store_true")
    p.add_argument("-O", "--output-format", choices=("vcf", "tsv"), default="tsv")
    p = command("rehead", "new header lines or sample IDs", "input", "output")
    p.add_argument("--headers", help="a file of ##key=value lines")
    p.add_argument("-I", "--sample-ids", help="a file of IDs, one a line")
    p = command("sort", "by contig and position", "input", "output")
    p.add_argument("-d", "--direction", choices=("asc", "desc"), default="asc")
    p.add_argument("-p", "--point", choices=("beg", "mid", "end"), default="beg")
    command("concat", "one after another", "inputs+", "output")
    p = command("stat", "summary, per-sample and per-count statistics", "input")
    p.add_argument("-r", "--regions", type=_words, default=())
    p.add_argument("-f", "--filter", default="")
    p.add_argument("--per-sample", action="store_true")
    p.add_argument("--per-ac", action="store_true")
    command("stat-index", "blocks and records of each contig", "input")
    command("stat-merge", "sums of statistics by their first column", "inputs+")
    return top


def _lines(df: DataFrame, head: bool = True) -> Iterator[str]:
    if head:
        yield "\t".join(df.columns)
    for row in df.toLocalIterator():
        yield "\t".join("." if x is None else str(x) for x in row)


def _selected(data: Dataset, a: argparse.Namespace) -> Dataset:
    if sum(bool(x) for x in (a.slice, a.regions, a.regions_file)) > 1:
        raise ValueError("of --slice, --regions and --regions-file only one may be given")
    if a.slice:
        data = data.slice(*(int(x) for x in a.slice.split(":")))
    if a.regions:
        data = data.region(*a.regions, how=a.bounding_point)
    if a.regions_file:
        data = data.regions_file(a.regions_file, a.bounding_point)
    ids = set(a.sample_ids or ())
    if a.sample_ids_file:
        ids |= {line.rstrip("\r\n") for line in open(a.sample_ids_file)}
    subset = a.sample_ids is not None or bool(a.sample_ids_file)
    data = data.filter(a.filter)
    if subset:
        data = data.subset(ids)
    if subset or a.generate_info:
        data = data.update_info(a.generate_info).declare_info(a.generate_info)
    if a.info_fields is not None:
        data = data.keep_info(list(a.info_fields))
    if a.phasing:
        data = data.with_phasing(a.phasing)
    return data.sites_only() if a.sites_only else data


def _write(data: Dataset, path: str, how: str, records: int = 0) -> None:
    (data.write_parquet if how == "parquet" else data.write_vcf)(path, records)


def run(spark: SparkSession, argv: list[str]) -> Iterator[str]:
    """Lines to print. Options are those of ``parser``; errors raise ValueError."""
    a = parser().parse_args(argv)
    if a.command == "stat-merge":
        tables = [spark.read.csv(x, sep="\t", header=True, inferSchema=True) for x in a.inputs]
        key = tables[0].columns[0]
        yield from _lines(stats.merge_summaries(tables, key).orderBy(key))
        return
    if a.command == "concat":
        parts = [Dataset.read(spark, x) for x in a.inputs]
        if len({len(p.samples) for p in parts}) > 1:
            raise ValueError("files have different numbers of samples")
        yield from _concat(parts, a.output)
        return
    data = Dataset.read(spark, a.input)
    if a.command in ("export", "import"):
        _write(_selected(data, a), a.output, a.output_format, a.block_size)
    elif a.command == "head":
        if a.sample_ids:
            yield from data.samples
        else:
            yield from (f"##{k}={v}" if a.output_format == "vcf" else f"{k}\t{v}" for k, v in data.head().toLocalIterator())
    elif a.command == "rehead":
        headers = None
        if a.headers:
            pairs = [line.rstrip("\r\n")[2:].partition("=") for line in open(a.headers) if line.startswith("##")]
            headers = spark.createDataFrame([(i, k, v) for i, (k, _, v) in enumerate(pairs)], "seq bigint, key string, value string")
        ids = [line.rstrip("\r\n") for line in open(a.sample_ids)] if a.sample_ids else None
        _write(data.rehead(headers, ids), a.output, "vcf")
    elif a.command == "sort":
        _write(data.sorted_rows(a.point, a.direction == "desc"), a.output, "vcf")
    elif a.command == "stat-index":
        yield from _lines(stats.index_summary(data.variants).orderBy("chrom"))
    else:
        picked = (data.region(*a.regions) if a.regions else data).filter(a.filter)
        yield from _lines(stats.summary(picked.variants))
        if a.per_sample:
            names = spark.createDataFrame(list(enumerate(data.samples)), "sample_idx int, id string")
            yield from _lines(names.join(stats.per_sample(picked.variants, len(data.samples)), "sample_idx").orderBy("sample_idx").drop("sample_idx"))
        if a.per_ac:
            yield from _lines(stats.per_allele_count(picked.variants).orderBy("ac"))


def _concat(parts: list[Dataset], path: str) -> Iterator[str]:
    from dataclasses import replace

    rows = order.concat([p.variants for p in parts], [len(p.samples) for p in parts]).drop("file_ord")
    _write(replace(parts[0], variants=rows), path, "vcf")
    yield from ()


def main() -> int:
    try:
        for line in run(get_spark(), sys.argv[1:]):
            print(line)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
