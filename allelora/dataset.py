"""A file's variants with its header and samples, and the operations on them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelora.functions.arrays import subset
from allelora.operators import filterlang, order, regions, stats
from allelora.sources import bcf
from allelora.sources import headers as header_ops
from allelora.sources import vcf
from allelora.sources.sniff import sniff

#: Statistics that ``update_info`` can write, with their descriptions.
INFO_STATISTICS = {"AC": "Alternate allele counts", "AN": "Number of alleles", "AF": "Alternate allele frequencies", "MAC": "Least allele count", "MAF": "Least allele frequency"}


@dataclass(frozen=True)
class Dataset:
    """Variants, header lines (seq, key, value), sample IDs and phasing. All methods return new datasets or frames."""

    variants: DataFrame
    headers: DataFrame
    samples: tuple[str, ...]
    phasing: str = "unknown"
    formats: dict[str, str] | None = None  # FORMAT IDs to element types, where they aren't those of the header

    @classmethod
    def read_vcf(cls, spark: SparkSession, path: str, formats: dict[str, str] | None = None) -> "Dataset":
        """A file, folder or several files of one header; ``formats`` (FORMAT ID to int, float or string) in place of the header's declarations."""
        lines = vcf.read_lines(spark, path)
        head = vcf.header_rows(lines)
        types = vcf.format_types(head) if formats is None else {k: t.removeprefix("array<").removesuffix(">") for k, t in formats.items()}
        return cls(vcf.variants(lines, types), head, tuple(vcf.sample_ids(lines)), vcf.phasing_of(head), formats and types)

    def format_types(self) -> dict[str, str]:
        return vcf.format_types(self.headers) if self.formats is None else self.formats

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Dataset":
        """VCF text (also compressed), BCF, or a folder that ``write_parquet`` wrote, told apart by the first bytes."""
        kind = sniff(spark, path)
        return {"vcf": cls.read_vcf, "parquet": cls.read_parquet, "bcf": cls.read_bcf}[kind](spark, path)

    @classmethod
    def read_bcf(cls, spark: SparkSession, path: str) -> "Dataset":
        head, samples = bcf.header_rows(spark, path)
        return cls(vcf.with_formats(bcf.read(spark, path).drop("file"), vcf.format_types(head)), head, samples, vcf.phasing_of(head))

    def _last(self):
        return F.col("end_pos") if "end_pos" in self.variants.columns else regions.end_pos(F.col("info"))

    def region(self, *texts: str, how: str = "beg") -> "Dataset":
        parsed = [regions.Region.parse(t) for t in texts]
        if len(parsed) == 1:
            return replace(self, variants=regions.in_region(self.variants, parsed[0], how, self._last()))
        return replace(self, variants=regions.in_regions(self.variants, parsed, how, self._last()))

    def regions_file(self, path: str, how: str = "beg") -> "Dataset":
        """Sites of the regions in a file of lines ``chrom<tab>start<tab>end``, with ``region_ord``, once for each region."""
        found = regions.join_regions(self.variants, regions.read_regions(self.variants.sparkSession, path), how, self._last())
        return replace(self, variants=found)

    def slice(self, begin: int, end: int) -> "Dataset":
        return replace(self, variants=regions.slice_rows(self.variants, begin, end))

    def filter(self, text: str) -> "Dataset":
        return replace(self, variants=self.variants.where(filterlang.compile_filter(text)))

    def subset(self, ids: set[str]) -> "Dataset":
        """Samples in ``ids`` in file order; unknown IDs are ignored."""
        keep, n = [i for i, s in enumerate(self.samples) if s in ids], max(1, len(self.samples))
        changed = self.variants
        for name in ["gt", "ph", *map(vcf.column_of, self.format_types())]:
            if name in changed.columns:
                changed = changed.withColumn(name, subset(F.col(name), keep, F.floor(F.size(name) / n).cast("int")))
        if "undeclared" in changed.columns:
            changed = changed.withColumn("undeclared", F.transform_values("undeclared", lambda _, v: subset(v, keep, 1)))
        return replace(self, variants=changed, samples=tuple(self.samples[i] for i in keep))

    def update_info(self, generate: tuple[str, ...] = (), mode: str = "compat") -> "Dataset":
        return replace(self, variants=stats.update_info(self.variants, generate, mode))

    def keep_info(self, keys: list[str]) -> "Dataset":
        kept = F.map_filter("info", lambda k, _: k.isin(keys))
        lines = header_ops.with_attributes(self.headers).where((F.col("key") != "INFO") | F.col("id").isin(keys)).select("seq", "key", "value")
        return replace(self, variants=self.variants.withColumn("info", kept), headers=lines)

    def sites_only(self) -> "Dataset":
        return replace(self, variants=self.variants.drop("gt", "ph", "format", "undeclared", *map(vcf.column_of, self.format_types())), samples=())

    def declare_info(self, keys: tuple[str, ...]) -> "Dataset":
        """Header lines for statistics that are to be in info, where they are missing."""
        number = {"AC": "A", "AF": "A"}
        kind = {"AF": "Float", "MAF": "Float"}
        lines = {k: f'<ID={k},Number={number.get(k, "1")},Type={kind.get(k, "Integer")},Description="{what}">' for k, what in INFO_STATISTICS.items() if k in keys}
        return replace(self, headers=header_ops.with_declared(self.headers, lines)) if lines else self

    def with_phasing(self, phasing: str) -> "Dataset":
        """The same calls under another phasing: phase bits are kept for ``partial`` only."""
        kept = self.headers.where("key != 'phasing'").select(F.col("seq").cast("bigint").alias("seq"), "key", "value")
        line = self.headers.sparkSession.createDataFrame([(-1, "phasing", phasing)], "seq bigint, key string, value string")
        # After the first line, which names the format.
        first = kept.withColumn("seq", F.when(F.col("key") == "fileformat", -2).otherwise(F.col("seq")))
        variants = self.variants if phasing == "partial" or "ph" not in self.variants.columns else self.variants.withColumn("ph", F.transform("ph", lambda x: F.lit(int(phasing == "full"))))
        return replace(self, variants=variants, headers=first.unionByName(line), phasing=phasing)

    def sorted_rows(self, point: str = "beg", descending: bool = False) -> "Dataset":
        """``sort`` with row_idx renumbered, so that writing keeps the order."""
        ranked = order.ranked(self.variants, self.contigs(), point, descending)
        return replace(self, variants=ranked.withColumn("row_idx", F.col("rank") - 1).drop("rank"))

    def drop_phase(self) -> "Dataset":
        return replace(self, variants=self.variants.drop("ph"), phasing="none")

    def contigs(self) -> DataFrame:
        lines = header_ops.with_attributes(self.headers.where("key = 'contig'"))
        return lines.select(F.col("id").alias("chrom"), F.col("seq").cast("int").alias("ord"))

    def sort(self, point: str = "beg", descending: bool = False) -> "Dataset":
        return replace(self, variants=order.sort_sites(self.variants, self.contigs(), point, descending))

    def head(self) -> DataFrame:
        return self.headers.orderBy("seq").select("key", "value")

    def rehead(self, headers: DataFrame | None = None, samples: list[str] | None = None) -> "Dataset":
        """New header lines, which must declare the old INFO, FORMAT and FILTER IDs first and in order, or as many new sample IDs."""
        if samples is not None and len(samples) != len(self.samples):
            raise ValueError("as many sample IDs are needed as there were")
        if headers is not None:
            ids = lambda h: [r[0] for r in header_ops.with_attributes(h).where(F.col("key").isin("INFO", "FORMAT", "FILTER")).orderBy("seq").select("id").collect()]
            old, new = list(dict.fromkeys(ids(self.headers))), list(dict.fromkeys(ids(headers)))
            if new[: len(old)] != old:
                raise ValueError("the new header doesn't begin with the old dictionary")
        return replace(self, headers=headers if headers is not None else self.headers, samples=tuple(samples) if samples is not None else self.samples)

    def write_vcf(self, path: str, records_per_file: int = 0) -> None:
        """VCF text parts that ``read_vcf`` reads again as a folder; the header's fileDate is today's."""
        vcf.write(self.variants, header_ops.with_file_date(self.headers), list(self.samples), path, self.format_types(), self.phasing, records_per_file)

    def write_parquet(self, path: str, records_per_file: int = 0) -> None:
        """Variants in folders by contig, sorted by position, so that contig and position prune the scan; header and samples beside them.

        ``end_pos`` is stored, so regions by end or overlap prune too. ``records_per_file`` bounds the records of a file (0: no bound).
        """
        spark = self.variants.sparkSession
        rows = self.variants.withColumn("end_pos", self._last())
        ranged = rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
        ranged.write.option("maxRecordsPerFile", records_per_file).partitionBy("chrom").parquet(f"{path}/variants")
        self.headers.write.parquet(f"{path}/headers")
        spark.createDataFrame([(i, s) for i, s in enumerate(self.samples)], "sample_idx int, sample_id string").coalesce(1).write.parquet(f"{path}/samples")

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str) -> "Dataset":
        head = spark.read.parquet(f"{path}/headers")
        samples = tuple(r[0] for r in spark.read.parquet(f"{path}/samples").orderBy("sample_idx").select("sample_id").collect())
        return cls(spark.read.parquet(f"{path}/variants"), head, samples, vcf.phasing_of(head))
