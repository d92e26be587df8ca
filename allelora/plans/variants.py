"""Queries of the variant operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from allelora.functions import arrays as A
from allelora.operators import assoc, filterlang, merge, order, pbwt, regions, stats
from allelora.session import table
from allelora.sources import headers as H
from allelora.sources import vcf

REGION = regions.Region.parse("chr6:50000000-90000000")
LIST = [regions.Region.parse(t) for t in ("chr1:1000000-30000000", "chr6:50000000-", "chr1:20000000-40000000", "chr19")]
ADJACENT = [("chr1", 10, 20), ("chr1", 5, 12), ("chr2", 7, 9), ("chr1", 40, 50), ("chr1", 45, 47), ("chrX", 1, 2)]
KEEP = [2, 4, 10, 11, 23]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _samples(spark: SparkSession, d: str) -> int:
    return table(spark, d, "sample_list").count()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LEN = "greatest(length(ref), coalesce(list_max(list_transform(alts, lambda a: length(a))), 0))"
_END = f"(pos + {_LEN} - 1)"
_IN = "chrom = 'chr6' AND"


#: A third of the sites reach as far as an END in their info says, so that the four bounding points differ.
_LAST = f"CASE WHEN pos % 3 = 0 THEN pos + pos % 3000000 ELSE {_END} END"


def _reaching(spark: SparkSession, d: str) -> DataFrame:
    rest = F.map_filter(F.coalesce("info", F.create_map().cast("map<string,string>")), lambda k, _: k != "END")
    end = F.map_from_arrays(F.array(F.lit("END")), F.array((F.col("pos") + F.col("pos") % 3_000_000).cast("string")))
    return table(spark, d, "variants").withColumn("info", F.when(F.col("pos") % 3 == 0, F.map_concat(rest, end)).otherwise(rest))


def _region(spark: SparkSession, d: str, how: str) -> DataFrame:
    return regions.in_region(_reaching(spark, d), REGION, how, regions.end_pos(F.col("info"))).select("row_idx", "chrom", "pos")


@query(f"SELECT row_idx, chrom, pos FROM variants WHERE {_IN} pos BETWEEN 50000000 AND 90000000")
def region_beg(spark, d):
    return _region(spark, d, "beg")


@query(f"SELECT row_idx, chrom, pos FROM variants WHERE {_IN} pos <= 90000000 AND {_LAST} >= 50000000")
def region_any(spark, d):
    return _region(spark, d, "any")


@query(f"SELECT row_idx, chrom, pos FROM variants WHERE {_IN} pos >= 50000000 AND {_LAST} <= 90000000")
def region_all(spark, d):
    return _region(spark, d, "all")


@query(f"SELECT row_idx, chrom, pos FROM variants WHERE {_IN} {_LAST} BETWEEN 50000000 AND 90000000")
def region_end(spark, d):
    return _region(spark, d, "end")


@query("""SELECT region_ord, row_idx FROM variants v JOIN (VALUES (0, 'chr1', 1000000, 30000000), (1, 'chr6', 50000000, 9000000000), (2, 'chr1', 20000000, 40000000), (3, 'chr19', 0, 9000000000)) r(region_ord, c, b, e)
ON v.chrom = r.c AND v.pos BETWEEN r.b AND r.e""")
def region_multi_dup(spark, d):
    return regions.in_regions(table(spark, d, "variants"), LIST).select("region_ord", "row_idx")


@query("SELECT v.row_idx, p.site_id FROM variants v JOIN panel_a p ON v.chrom = p.chrom AND v.pos BETWEEN p.pos AND p.pos + 20000")
def region_join(spark, d):
    r = table(spark, d, "panel_a").select("site_id", "chrom", F.col("pos").cast("bigint").alias("start"), (F.col("pos") + 20000).cast("bigint").alias("end"))
    return regions.join_regions(table(spark, d, "variants").select("row_idx", "chrom", "pos"), r).select("row_idx", "site_id")


def _point_join(how: str, condition: str) -> None:
    """Regions of a table, joined by a bounding point."""

    @query(f"SELECT v.row_idx, p.site_id FROM (SELECT row_idx, chrom, pos, {_LAST} AS last FROM variants) v JOIN (SELECT site_id, chrom, pos AS b, pos + 300000 AS e FROM panel_a) p ON v.chrom = p.chrom AND {condition}")
    def join(spark, d):
        r = table(spark, d, "panel_a").select("site_id", "chrom", F.col("pos").cast("bigint").alias("start"), (F.col("pos") + 300_000).cast("bigint").alias("end"))
        sites = _reaching(spark, d).select("row_idx", "chrom", "pos", regions.end_pos(F.col("info")).alias("last"))
        return regions.join_regions(sites, r, how, F.col("last")).select("row_idx", "site_id")

    QUERIES[f"region_join_{how}"], SQL[f"region_join_{how}"] = QUERIES.pop("join"), SQL.pop("join")


_point_join("any", "v.pos <= p.e AND v.last >= p.b")
_point_join("all", "v.pos >= p.b AND v.last <= p.e")
_point_join("end", "v.pos <= p.e AND v.last BETWEEN p.b AND p.e")


@query('SELECT chrom, min(pos) AS start, max(pos + 100) AS "end" FROM panel_a GROUP BY chrom')
def region_envelope(spark, d):
    return regions.envelope(table(spark, d, "panel_a").select("chrom", F.col("pos").alias("start"), (F.col("pos") + 100).alias("end")))


@query("""WITH r AS (SELECT * FROM (VALUES (0, 'chr1', 10, 20), (1, 'chr1', 5, 12), (2, 'chr2', 7, 9), (3, 'chr1', 40, 50), (4, 'chr1', 45, 47), (5, 'chrX', 1, 2)) t(o, chrom, b, e)),
n AS (SELECT *, CASE WHEN lag(chrom) OVER (ORDER BY o) = chrom THEN 0 ELSE 1 END AS new FROM r)
SELECT CAST(run AS BIGINT) AS run, chrom, min(b) AS start, max(e) AS "end" FROM (SELECT *, sum(new) OVER (ORDER BY o) AS run FROM n) GROUP BY run, chrom""")
def adjacent_region_merge(spark, d):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(ADJACENT)], "region_ord int, chrom string, start int, end int")
    return regions.merge_adjacent(rows)


@query("SELECT row_idx, chrom, pos FROM variants WHERE row_idx >= 1000 AND row_idx < 2500")
def slice_rows(spark, d):
    return regions.slice_rows(table(spark, d, "variants"), 1000, 2500).select("row_idx", "chrom", "pos")


@query("SELECT chrom, min(row_idx) AS first_row FROM variants GROUP BY chrom")
def chrom_distinct(spark, d):
    return regions.chromosomes(table(spark, d, "variants"))


def _atof(text: str) -> str:
    return rf"CASE WHEN regexp_matches({text}, '^\s*[+-]?(?i:nan)') THEN NULL WHEN regexp_matches({text}, '^\s*[+]?(?i:inf)') THEN 1e308 WHEN regexp_matches({text}, '^\s*-(?i:inf)') THEN -1e308 ELSE coalesce(TRY_CAST(nullif(regexp_extract({text}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'), '') AS DOUBLE), 0) END"


def _info(key: str) -> str:
    return f"coalesce(info['{key}'], '')"


def _filter(spark, d, text):
    return table(spark, d, "variants").where(filterlang.compile_filter(text)).select("row_idx")


@query(f"SELECT row_idx FROM variants WHERE {_atof(_info('DP'))} >= 50 AND {_atof(_info('AF'))} < 0.1")
def filter_numeric(spark, d):
    return _filter(spark, d, "DP>=50 & AF<0.1")


@query(f"SELECT row_idx FROM variants WHERE regexp_matches({_info('AA')}, '^[AC]') AND NOT regexp_matches({_info('LOD')}, 'e-')")
def filter_regex(spark, d):
    return _filter(spark, d, "AA=~'^[AC]'&LOD!~'e-'")


@query(f"SELECT row_idx FROM variants WHERE {_atof(_info('DP'))} > 50 AND ({_atof(_info('AF'))} > 0.5 OR {_atof(_info('NS'))} > 10)")
def filter_right_assoc(spark, d):
    return _filter(spark, d, "DP>50&AF>0.5|NS>10")


@query(f"SELECT row_idx FROM variants WHERE {_atof(_info('LOD'))} < 0.1")
def filter_missing_zero(spark, d):
    return _filter(spark, d, "LOD<0.1")


@query(f"SELECT row_idx FROM variants WHERE {_info('DB')} = '.' AND {_info('H2')} = ''")
def filter_flag(spark, d):
    return _filter(spark, d, "DB=='.'&H2==''")


@query(f"SELECT row_idx FROM variants WHERE qual IS NOT NULL AND NOT isnan(qual) AND (qual = 'inf' OR (NOT isinf(qual) AND {_atof(chr(39) + chr(39) + ' || printf(' + chr(39) + '%.6g' + chr(39) + ', CAST(qual AS DOUBLE))')} >= 30)) AND array_to_string(filters, ';') = 'PASS'")
def filter_site(spark, d):
    return _filter(spark, d, "QUAL>=30&FILTER=='PASS'")


@query("SELECT row_idx, gt[5:6] || gt[9:10] || gt[21:24] || gt[47:48] AS gt FROM variants")
def subset_samples(spark, d):
    return table(spark, d, "variants").select("row_idx", A.subset(F.col("gt"), KEEP, 2).alias("gt"))


_OFF = "list_filter(range(len(gt)), lambda i: gt[i + 1] <> 0)"


@query(f"SELECT row_idx, CAST(len(gt) AS INTEGER) AS size, {_OFF} AS offsets, list_transform({_OFF}, lambda i: gt[i + 1]) AS \"values\" FROM variants")
def sparse_encode(spark, d):
    s = A.to_sparse(F.col("gt"))
    return table(spark, d, "variants").select("row_idx", s["size"].alias("size"), s["offsets"].alias("offsets"), s["values"].alias("values"))


@query("SELECT row_idx, gt FROM variants")
def sparse_roundtrip(spark, d):
    return table(spark, d, "variants").select("row_idx", A.to_dense(A.to_sparse(F.col("gt"))).alias("gt"))


@query(f"SELECT row_idx, array_to_string({_OFF}, ',') AS offsets, array_to_string(list_transform({_OFF}, lambda i: gt[i + 1]), ',') AS \"values\" FROM variants WHERE gt IS NOT NULL")
def sparse_texts(spark, d):
    s = A.to_sparse(F.col("gt"))
    rows = table(spark, d, "variants").where("gt IS NOT NULL").select("row_idx", s.alias("s"))
    return rows.select("row_idx", F.array_join("s.offsets", ",").alias("offsets"), F.array_join("s.values", ",").alias("values"))


@query("SELECT row_idx, gt FROM variants")
def pbwt_roundtrip(spark, d):
    return pbwt.unsort(pbwt.sort(table(spark, d, "variants")))


@query(f"SELECT row_idx, list_filter({_OFF}, lambda o: o // 2 IN (2, 4, 10, 11, 23)) AS kept FROM variants")
def sparse_subset(spark, d):
    """Offsets of the kept samples' non-zeros, before moving: the subset's offsets moved back."""
    s = A.sparse_subset(A.to_sparse(F.col("gt")), KEEP, 2, _samples(spark, d))
    back = F.array(*map(F.lit, KEEP))
    return table(spark, d, "variants").select("row_idx", F.transform(s["offsets"], lambda o: F.get(back, F.floor(o / 2).cast("int")) * 2 + o % 2).alias("kept"))


@query(f"WITH o AS (SELECT row_idx, {_OFF} AS o FROM variants) SELECT row_idx, list_transform(o, lambda x, i: x - CASE WHEN i = 1 THEN 0 ELSE o[i - 1] + 1 END) AS gaps, o AS offsets FROM o")
def delta_offsets(spark, d):
    rows = table(spark, d, "variants").select("row_idx", A.delta_encode(A.to_sparse(F.col("gt"))["offsets"]).alias("gaps"))
    return rows.withColumn("offsets", A.delta_decode(F.col("gaps")))


_SUMS = "list_transform(range(len(gt) // 2), lambda i: CASE WHEN gt[2 * i + 1] = -2147483647 THEN 0 ELSE gt[2 * i + 1] END + CASE WHEN gt[2 * i + 2] = -2147483647 THEN 0 ELSE gt[2 * i + 2] END)"


@query(f"SELECT row_idx, {_SUMS} AS sums FROM variants")
def stride_reduce(spark, d):
    return table(spark, d, "variants").select("row_idx", A.stride_reduce(F.col("gt"), 2).alias("sums"))


@query(f"SELECT row_idx, {_SUMS} AS sums FROM variants")
def stride_reduce_sparse(spark, d):
    return table(spark, d, "variants").select("row_idx", A.to_dense(A.sparse_stride_reduce(A.to_sparse(F.col("gt")), 2), "bigint").alias("sums"))


@query("SELECT row_idx, CAST(list_sum(list_transform(range(least(len(dp), len(gq))), lambda i: dp[i + 1] * gq[i + 1])) AS DOUBLE) AS dot FROM variants")
def sparse_dot(spark, d):
    return table(spark, d, "variants").select("row_idx", A.sparse_dot(A.to_sparse(F.col("dp")), A.to_sparse(F.col("gq"))).alias("dot"))


_AC = "list_transform(alts, lambda a, i: len(list_filter(gt, lambda x: x = i)))"
_AN = "len(list_filter(gt, lambda x: x >= 0))"
_STATS = f"SELECT row_idx, CASE WHEN gt IS NOT NULL THEN {_AC} END AS ac, {_AN} AS an FROM variants"


@query(f"SELECT row_idx, ac, CAST(an AS INTEGER) AS an, list_transform(ac, lambda c: round(c / nullif(an, 0), 6)) AS af FROM ({_STATS})")
def info_ac_an_af(spark, d):
    return stats.with_allele_stats(table(spark, d, "variants")).select("row_idx", "ac", "an", F.transform("af", lambda x: F.round(x, 6)).alias("af"))


@query(f"SELECT row_idx, list_min(ac) AS mac, round(list_min(ac) / nullif(an, 0), 6) AS maf FROM ({_STATS})")
def info_mac_maf(spark, d):
    return stats.with_allele_stats(table(spark, d, "variants")).select("row_idx", "mac", F.round("maf", 6).alias("maf"))


@query(f"SELECT row_idx, CASE WHEN gt IS NULL THEN NULL WHEN len(alts) = 1 THEN [len({_OFF})] ELSE {_AC} END AS ac, CAST(len(gt) AS INTEGER) AS an FROM variants")
def info_compat_sparse(spark, d):
    return stats.with_allele_stats(table(spark, d, "variants"), "compat").select("row_idx", "ac", "an")


@query(f"SELECT row_idx, CASE WHEN gt IS NULL OR len({_AC}) = 0 THEN info['AC'] ELSE array_to_string({_AC}, ',') END AS ac, CASE WHEN gt IS NULL THEN info['AN'] ELSE CAST({_AN} AS VARCHAR) END AS an FROM variants")
def info_update(spark, d):
    done = stats.update_info(table(spark, d, "variants"), ("AC", "AN"), "strict")
    return done.select("row_idx", F.col("info")["AC"].alias("ac"), F.col("info")["AN"].alias("an"))


@query("SELECT row_idx, len(map_keys(info)) AS n, info['DP'] AS dp FROM (SELECT row_idx, map_from_entries(list_filter(map_entries(info), lambda e: e.key IN ('DP', 'NS'))) AS info FROM variants)")
def info_fields(spark, d):
    kept = F.map_filter("info", lambda k, _: k.isin("DP", "NS"))
    return table(spark, d, "variants").select("row_idx", kept.alias("info")).select("row_idx", F.size("info").alias("n"), F.col("info")["DP"].alias("dp"))


@query("SELECT count(*) AS n_records, CAST(sum(greatest(coalesce(len(alts), 0), 1)) AS BIGINT) AS n_variants, count(*) FILTER (WHERE len(alts) > 1) AS n_multi FROM variants")
def stat_summary(spark, d):
    return stats.summary(table(spark, d, "variants"))


_SNP = "coalesce(length(ref) = 1 AND length(alts[1]) = 1, false)"
_LONG = f"""
WITH v AS (SELECT row_idx, {_SNP} AS snp, gt, len(gt) // 24 AS p FROM variants WHERE len(gt) >= 24),
s AS (SELECT row_idx, snp, gt, p, unnest(range(24)) AS i FROM v),
h AS (SELECT row_idx, snp, CAST(i AS INTEGER) AS i, list_filter(gt[i * p + 1:i * p + p], lambda x: x <> -2147483647) AS h FROM s),
g AS (SELECT row_idx, snp, i, CASE WHEN len(list_filter(h, lambda x: x < 0)) = 0 THEN coalesce(list_sum(h), 0) END AS g FROM h)
"""


_ANN = "CASE pos % 5 WHEN 0 THEN 'C|missense|x,G|synonymous|y' WHEN 1 THEN 'C|intron&stop_retained|x' WHEN 2 THEN 'C|synonymous|a,T|intron&stop_gained|b' WHEN 3 THEN 'C' END"
_EFFECT = "CASE pos % 5 WHEN 0 THEN 'nonsyn' WHEN 1 THEN 'syn' WHEN 2 THEN 'nonsyn' END"


def _annotated(spark, d):
    """The sites with an annotation in their info, made from their position."""
    rest = F.map_filter(F.coalesce("info", F.create_map().cast("map<string,string>")), lambda k, _: k != "ANN")
    return table(spark, d, "variants").withColumn("info", F.map_concat(rest, F.map_from_arrays(F.array(F.lit("ANN")), F.array(F.expr(_ANN)))))


@query(_LONG + f"""SELECT i AS sample_idx, count(*) FILTER (WHERE g = 1) AS n_het, count(*) FILTER (WHERE g > 1) AS n_hom, CAST(sum(CASE WHEN snp AND g > 0 THEN g ELSE 0 END) AS BIGINT) AS n_snp,
CAST(sum(CASE WHEN NOT snp AND g > 0 THEN g ELSE 0 END) AS BIGINT) AS n_indel,
CAST(sum(CASE WHEN effect = 'syn' AND g > 0 THEN g ELSE 0 END) AS BIGINT) AS n_syn, CAST(sum(CASE WHEN effect = 'nonsyn' AND g > 0 THEN g ELSE 0 END) AS BIGINT) AS n_nonsyn
FROM g JOIN (SELECT row_idx, {_EFFECT} AS effect FROM variants) USING (row_idx) GROUP BY i""")
def stat_per_sample(spark, d):
    return stats.per_sample(_annotated(spark, d), _samples(spark, d))


@query(f"""WITH v AS (SELECT CASE WHEN gt IS NULL OR len({_AC}) = 0 THEN TRY_CAST(split_part(info['AC'], ',', 1) AS INTEGER) ELSE ({_AC})[1] END AS ac, CASE WHEN gt IS NULL THEN TRY_CAST(info['AN'] AS INTEGER) ELSE {_AN} END AS an, {_SNP} AS snp, {_EFFECT} AS effect FROM variants),
k AS (SELECT * FROM v WHERE ac BETWEEN 0 AND an), b AS (SELECT unnest(range(max(an) + 1)) AS ac FROM k)
SELECT CAST(b.ac AS INTEGER) AS ac, count(*) FILTER (WHERE snp) AS n_snp, count(*) FILTER (WHERE NOT snp) AS n_indel, count(*) FILTER (WHERE effect = 'syn') AS n_syn, count(*) FILTER (WHERE effect = 'nonsyn') AS n_nonsyn FROM b LEFT JOIN k ON k.ac = b.ac GROUP BY b.ac""")
def stat_per_ac(spark, d):
    return stats.per_allele_count(stats.update_info(_annotated(spark, d), ("AC", "AN"), "strict"))


@query(f"SELECT row_idx, {_EFFECT} AS effect FROM variants")
def stat_ann_class(spark, d):
    return table(spark, d, "variants").select("row_idx", F.expr(_ANN).alias("ann")).select("row_idx", stats.effect_class(F.col("ann")).alias("effect"))


@query(f"SELECT chrom, count(DISTINCT row_idx // 4096) AS n_blocks, count(*) AS n_records, min(pos) AS min_pos, max({_END}) AS max_end FROM variants GROUP BY chrom")
def stat_index(spark, d):
    return stats.index_summary(table(spark, d, "variants"))


@query("SELECT chrom, count(*) AS n, count(qual) AS n_qual FROM variants GROUP BY chrom")
def stat_merge(spark, d):
    rows = table(spark, d, "variants")
    part = lambda c: rows.where(c).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.count("qual").alias("n_qual"))
    return stats.merge_summaries([part("load_id < 5"), part("load_id >= 5"), part("load_id IS NULL")], "chrom")


def _rank(spark, d, point, descending=False):
    sites = table(spark, d, "variants").select("row_idx", "chrom", "pos", "ref", "alts")
    return order.ranked(sites, table(spark, d, "contigs"), point, descending).select("row_idx", "rank")


def _rank_sql(key: str, down: str = "") -> str:
    return f"SELECT row_idx, row_number() OVER (ORDER BY coalesce(ord, 2147483647) {down}, v.chrom {down}, {key} {down}, row_idx {down}) AS rank FROM variants v LEFT JOIN contigs c ON v.chrom = c.chrom"


@query(_rank_sql("pos"))
def sort_beg(spark, d):
    return _rank(spark, d, "beg")


@query(_rank_sql(f"pos + {_LEN} / 2.0"))
def sort_mid(spark, d):
    return _rank(spark, d, "mid")


@query(_rank_sql(f"pos + {_LEN}"))
def sort_end(spark, d):
    return _rank(spark, d, "end")


@query(_rank_sql("pos", "DESC"))
def sort_desc(spark, d):
    return _rank(spark, d, "beg", True)


@query("SELECT row_idx, 0 AS file_ord, pos FROM variants UNION ALL SELECT row_idx + (SELECT count(*) FROM variants), 1, pos FROM variants")
def concat(spark, d):
    rows = table(spark, d, "variants").select("row_idx", "pos")
    return order.concat([rows, rows], [_samples(spark, d)] * 2).select("row_idx", "file_ord", "pos")


@query("SELECT sample_idx, sample_id, y FROM sample_list WHERE y IS NOT NULL AND NOT isnan(y)")
def pheno_join(spark, d):
    samples = table(spark, d, "sample_list")
    return assoc.phenotypes(samples.select("sample_idx", "sample_id"), samples.select("sample_id", "y", F.col("sample_idx").alias("line")))


def _responses(spark, d) -> dict[int, float]:
    return {r["sample_idx"]: r["y"] for r in pheno_join(spark, d).select("sample_idx", "y").orderBy("sample_idx").collect()}


_REG = _LONG + """, r AS (SELECT row_idx, CAST(g AS DOUBLE) AS x, y FROM g JOIN sample_list l ON l.sample_idx = g.i WHERE g IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)),
m AS (SELECT row_idx, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM r GROUP BY row_idx),
b AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS beta, CASE WHEN sx > (2 * n) // 2 THEN 2 * n - sx ELSE sx END AS mac FROM m),
e AS (SELECT *, CASE WHEN n > 2 THEN sqrt(greatest((n * syy - sy * sy - beta * beta * (n * sxx - sx * sx)) / nullif((n - 2) * (n * sxx - sx * sx), 0), 0)) END AS se FROM b)
"""
#: Added before rounding: many results are short fractions, which rounding would find halfway between two decimals.
_OFF_TIES = 1.23456e-9
_NEAR = lambda c, name: (F.round(F.col(c) + _OFF_TIES, 7) + F.lit(0.0)).alias(name)


@query(_REG + "SELECT row_idx, mac, round(beta + 1.23456e-9, 7) + 0.0 AS beta, CASE WHEN beta IS NOT NULL THEN round(se + 1.23456e-9, 7) + 0.0 END AS se FROM e WHERE mac >= 1")
def assoc_linreg(spark, d):
    found = assoc.associate(table(spark, d, "variants"), _responses(spark, d), _samples(spark, d))
    return found.select("row_idx", "mac", _NEAR("beta", "beta"), _NEAR("se", "se"))


#: Two-sided p of t at a whole number nu of degrees of freedom, as a finite sum.
_TERM = "list_product(list_transform(range(1, k + 1), lambda j: CAST(2 * j - {0} AS DOUBLE) / (2 * j + 1 - {0})))"
_PVALUE = f"""CASE WHEN nu % 2 = 0 THEN 1 - sin(th) * (1 + coalesce(list_sum(list_transform(range(1, nu // 2), lambda k: {_TERM.format(1)} * power(cos(th), 2 * k))), 0))
ELSE 1 - 2 / pi() * (th + CASE WHEN nu > 1 THEN sin(th) * cos(th) * (1 + coalesce(list_sum(list_transform(range(1, (nu - 1) // 2), lambda k: {_TERM.format(0)} * power(cos(th), 2 * k))), 0)) ELSE 0 END) END"""
_P = f"SELECT row_idx, round(t + 1.23456e-9, 7) + 0.0 AS t, CASE WHEN t IS NOT NULL THEN round({_PVALUE} + 1.23456e-9, 7) + 0.0 END AS pval FROM (SELECT *, atan(abs(t) / sqrt(nu)) AS th FROM (SELECT row_idx, mac, CAST(n - 2 AS BIGINT) AS nu, beta / nullif(se, 0) AS t FROM {{0}}))"


@query(_REG + _P.format("e WHERE mac >= 1"))
def assoc_pvalue(spark, d):
    found = assoc.associate(table(spark, d, "variants"), _responses(spark, d), _samples(spark, d))
    return found.select("row_idx", _NEAR("t", "t"), _NEAR("pval", "pval"))


_COVARIED = _LONG + """, r AS (SELECT row_idx, CAST(g AS DOUBLE) AS x, y, CAST(sex AS DOUBLE) AS z FROM g JOIN sample_list l ON l.sample_idx = g.i WHERE g IS NOT NULL AND y IS NOT NULL AND NOT isnan(y) AND sex IS NOT NULL),
m AS (SELECT row_idx, count(*) AS n, sum(x * x) - sum(x) * sum(x) / count(*) AS xx, sum(z * z) - sum(z) * sum(z) / count(*) AS zz, sum(y * y) - sum(y) * sum(y) / count(*) AS yy,
  sum(x * z) - sum(x) * sum(z) / count(*) AS xz, sum(x * y) - sum(x) * sum(y) / count(*) AS xy, sum(z * y) - sum(z) * sum(y) / count(*) AS zy FROM r GROUP BY row_idx),
c AS (SELECT row_idx, n, xx - xz * xz / zz AS xx, xy - xz * zy / zz AS xy, yy - zy * zy / zz AS yy FROM m WHERE n > 3 AND zz > 1e-9),
b AS (SELECT row_idx, n, xy / xx AS beta, sqrt(greatest((yy - xy * xy / xx) / (n - 3), 0) / xx) AS se FROM c WHERE xx > 1e-9)
SELECT row_idx, round(beta + 1.23456e-9, 7) + 0.0 AS beta, round(se + 1.23456e-9, 7) + 0.0 AS se FROM variants LEFT JOIN b USING (row_idx)"""


def _sex(spark, d) -> dict[int, list[float]]:
    return {r["sample_idx"]: [float(r["sex"])] for r in table(spark, d, "sample_list").where("sex IS NOT NULL").select("sample_idx", "sex").collect()}


@query(_COVARIED)
def assoc_covariates(spark, d):
    found = assoc.regress_many(table(spark, d, "variants"), _responses(spark, d), _sex(spark, d), _samples(spark, d))
    return found.select("row_idx", _NEAR("beta", "beta"), _NEAR("se", "se"))


_FIRST = "TRY_CAST(string_split(info['{0}'], ',')[1] AS DOUBLE)"
_RUN = (
    _REG.replace("SELECT row_idx, CAST(g AS DOUBLE) AS x, y FROM g JOIN sample_list l", "SELECT row_idx, CAST(g AS DOUBLE) AS x, y FROM g JOIN (SELECT sample_idx, y - (regr_intercept(y, sex) OVER () + regr_slope(y, sex) OVER () * sex) AS y FROM sample_list WHERE y IS NOT NULL AND NOT isnan(y) AND sex IS NOT NULL) l")
    + f""", k AS (SELECT e.row_idx, beta, se, CAST(n - 2 AS BIGINT) AS nu, CASE WHEN has THEN ac WHEN af IS NOT NULL THEN af * 48 ELSE sx END AS ac, CASE WHEN has THEN an WHEN af IS NOT NULL THEN 48 ELSE 2 * n END AS an
  FROM e JOIN (SELECT row_idx, {_FIRST.format('AC')} AS ac, {_FIRST.format('AN')} AS an, {_FIRST.format('AF')} AS af, {_FIRST.format('AC')} IS NOT NULL AND {_FIRST.format('AN')} IS NOT NULL AS has FROM variants) USING (row_idx)),
f AS (SELECT *, CASE WHEN ac > floor(an / 2) THEN an - ac ELSE ac END AS mac, CASE WHEN ac / nullif(an, 0) > 0.5 THEN 1 - ac / nullif(an, 0) ELSE ac / nullif(an, 0) END AS maf FROM k)
SELECT row_idx, round(maf, 6) AS maf, round(mac, 6) AS mac, round(beta + 1.23456e-9, 7) + 0.0 AS beta, CASE WHEN beta IS NOT NULL THEN round(se + 1.23456e-9, 7) + 0.0 END AS se FROM f WHERE mac >= 1"""
)


@query(_RUN)
def assoc_run(spark, d):
    """A whole association run: the response less what sex explains, allele counts by the sites' info."""
    found = assoc.associate_sites(table(spark, d, "variants"), _responses(spark, d), _sex(spark, d), "gt", _samples(spark, d))
    return found.select("row_idx", F.round("maf", 6).alias("maf"), F.round("mac", 6).alias("mac"), _NEAR("beta", "beta"), _NEAR("se", "se"))


@query(_REG + "SELECT row_idx, round(beta + 1.23456e-9, 7) + 0.0 AS beta, CASE WHEN beta IS NOT NULL THEN round(se + 1.23456e-9, 7) + 0.0 END AS se FROM e")
def assoc_sparse(spark, d):
    ds = table(spark, d, "variants").select("row_idx", assoc.dosages(_samples(spark, d)).alias("ds"))
    rows = ds.select("row_idx", assoc.sparse_moments(A.to_sparse(F.col("ds")), _responses(spark, d)).alias("m"))
    return assoc.regression(rows).where("m.n > 0").select("row_idx", _NEAR("beta", "beta"), _NEAR("se", "se"))


@query(_REG + "SELECT row_idx, round((sy - beta * sx) / n + 1.23456e-9, 7) + 0.0 AS intercept, round((n * sxy - sx * sy) * (n * sxy - sx * sy) / nullif((n * sxx - sx * sx) * (n * syy - sy * sy), 0) + 1.23456e-9, 7) + 0.0 AS r2 FROM e")
def regr_r2(spark, d):
    rows = assoc.site_moments(table(spark, d, "variants"), _responses(spark, d), _samples(spark, d), ("row_idx",)).where("m.n > 0")
    return assoc.regression(rows).select("row_idx", _NEAR("intercept", "intercept"), _NEAR("r2", "r2"))


_H = "CAST(hds[2 * i + {0}] AS DOUBLE)"
_P = {"a": _H.format(1), "b": _H.format(2)}


@query("SELECT row_idx, list_transform(range(len(hds) // 2), lambda i: round({a} + {b}, 5)) AS ds FROM variants".format(**_P))
def hds_to_ds(spark, d):
    return table(spark, d, "variants").select("row_idx", F.transform(A.hds_to_ds(F.col("hds")), lambda x: F.round(x, 5)).alias("ds"))


@query("SELECT row_idx, flatten(list_transform(range(len(hds) // 2), lambda i: [round((1 - {a}) * (1 - {b}), 5), round({a} * (1 - {b}) + {b} * (1 - {a}), 5), round({a} * {b}, 5)])) AS gp FROM variants".format(**_P))
def hds_to_gp(spark, d):
    return table(spark, d, "variants").select("row_idx", F.transform(A.hds_to_gp(F.col("hds")), lambda x: F.round(x, 5)).alias("gp"))


@query("SELECT row_idx, list_transform(hds, lambda x: CAST(floor(x + 0.5) AS INTEGER)) AS gt FROM variants")
def hds_to_gt(spark, d):
    return table(spark, d, "variants").select("row_idx", A.hds_to_gt(F.col("hds")).alias("gt"))


@query(r"""WITH c AS (SELECT line_id, string_split(regexp_replace(line, '\r$', ''), chr(9)) AS f FROM vcf_lines), t AS (SELECT line_id, CAST(i - 10 AS INTEGER) AS sample_idx, split_part(f[i], ':', 1) AS g FROM (SELECT line_id, f, unnest(range(10, len(f) + 1)) AS i FROM c)),
k AS (SELECT * FROM t WHERE regexp_full_match(g, '(\.|[0-9]{1,6})([/|](\.|[0-9]{1,6}))?')), s AS (SELECT line_id, sample_idx, g, string_split(translate(g, '|', '/'), '/') AS p FROM k)
SELECT line_id, sample_idx, [CASE WHEN p[1] = '.' THEN -1 ELSE CAST(p[1] AS INTEGER) END, CASE WHEN len(p) < 2 THEN -2147483647 WHEN p[2] = '.' THEN -1 ELSE CAST(p[2] AS INTEGER) END] AS gt, CASE WHEN len(p) < 2 THEN [] WHEN contains(g, '|') THEN [1] ELSE [0] END AS ph FROM s""")
def gt_phase_parse(spark, d):
    """The calls of all samples of all lines."""
    cells = F.split(F.regexp_replace("line", r"\r\z", ""), "\t")
    calls = F.transform(F.slice(cells, F.lit(10), F.greatest(F.size(cells) - 9, F.lit(0))), lambda c: F.substring_index(c, ":", 1))
    rows = table(spark, d, "vcf_lines").select("line_id", F.posexplode(calls).alias("sample_idx", "g")).where(F.col("g").rlike(r"\A(\.|[0-9]{1,6})([/|](\.|[0-9]{1,6}))?\z"))
    return rows.select("line_id", "sample_idx", A.gt_alleles(F.col("g")).alias("gt"), A.gt_phases(F.col("g")).alias("ph"))


@query("SELECT row_idx, list_transform(gt, lambda x, i: CASE WHEN x = -2147483647 THEN x ELSE (x + 1) * 2 + CASE WHEN i % 2 = 0 THEN coalesce(ph[(i + 1) // 2], 0) ELSE 0 END END) AS codes, gt AS back FROM variants")
def bcf_gt_code(spark, d):
    rows = table(spark, d, "variants").select("row_idx", A.bcf_encode(F.col("gt"), F.col("ph")).alias("codes"))
    return rows.withColumn("back", A.bcf_decode(F.col("codes")))


_CALLS = """array_to_string(list_transform(range(len(gt) // 2), lambda i:
  CASE WHEN gt[2 * i + 1] = -2147483647 THEN '' WHEN gt[2 * i + 1] = -1 THEN '.' ELSE CAST(gt[2 * i + 1] AS VARCHAR) END ||
  CASE WHEN gt[2 * i + 2] = -2147483647 THEN '' ELSE CASE WHEN gt[2 * i + 1] = -2147483647 THEN '' WHEN ph[i + 1] = 1 THEN '|' ELSE '/' END || CASE WHEN gt[2 * i + 2] = -1 THEN '.' ELSE CAST(gt[2 * i + 2] AS VARCHAR) END END), chr(9))"""
_DOT = "coalesce(nullif({0}, ''), '.')"
_INFO = "array_to_string(list_transform(map_keys(info), lambda k: CASE WHEN info[k] = '.' THEN k ELSE k || '=' || info[k] END), ';')"


@query(f"""SELECT row_idx, concat_ws(chr(9), {_DOT.format('chrom')}, CAST(pos AS VARCHAR), {_DOT.format('id')}, {_DOT.format('ref')}, {_DOT.format("array_to_string(alts, ',')")},
coalesce(CASE WHEN isnan(qual) THEN 'nan' WHEN qual = 'inf' THEN 'inf' WHEN qual = '-inf' THEN '-inf' ELSE printf('%.6g', CAST(qual AS DOUBLE)) END, '.'), {_DOT.format("array_to_string(filters, ';')")}, {_DOT.format(_INFO)}, CASE WHEN gt IS NOT NULL THEN 'GT' END, CASE WHEN gt IS NOT NULL THEN {_CALLS} END) AS line FROM variants""")
def vcf_line_render(spark, d):
    return vcf.render(table(spark, d, "variants"))


@query("SELECT row_idx, CAST(i AS INTEGER) AS alt_idx, alts[i] AS alt, list_transform(gt, lambda x: CASE WHEN x < 0 THEN x WHEN x = i THEN 1 ELSE 0 END) AS gt FROM (SELECT row_idx, alts, gt, unnest(range(1, len(alts) + 1)) AS i FROM variants)")
def split_multiallelic(spark, d):
    return merge.split_alternatives(table(spark, d, "variants").select("row_idx", "alts", "gt")).select("row_idx", "alt_idx", "alt", "gt")


_SIDE = "(SELECT chrom, pos, ref, unnest(alts) AS alt, gt FROM {0})"


@query(f"""SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt,
coalesce(a.gt, [0 FOR x IN range(16)]) || coalesce(b.gt, [0 FOR x IN range(16)]) AS gt FROM {_SIDE.format('panel_a')} a FULL JOIN {_SIDE.format('panel_b')} b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt""")
def merge_outer(spark, d):
    side = lambda name: table(spark, d, name).select("chrom", "pos", "ref", F.explode("alts").alias("alt"), "gt")
    return merge.merge_sites(side("panel_a"), side("panel_b"), 16, 16)


_FILE = "(SELECT chrom, pos, ref, alts, gt, qual, row_number() OVER (PARTITION BY chrom, pos, ref, alts ORDER BY site_id, qual NULLS FIRST, gt) AS nth FROM {0})"
_JOINED = "{0}.chrom IS NOT DISTINCT FROM {1}.chrom AND {0}.pos IS NOT DISTINCT FROM {1}.pos AND {0}.ref IS NOT DISTINCT FROM {1}.ref AND {0}.alts IS NOT DISTINCT FROM {1}.alts AND {0}.nth = {1}.nth"
_THREE = f"""WITH a AS {_FILE.format('panel_a')}, b AS {_FILE.format('panel_b')}, z AS (SELECT [0 FOR x IN range(16)] AS zero),
ab AS (SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ref, b.ref) AS ref, coalesce(a.alts, b.alts) AS alts, a.nth IS NOT NULL AS in_a, b.nth IS NOT NULL AS in_b, a.gt AS ga, b.gt AS gb
  FROM a FULL JOIN b ON {_JOINED.format('a', 'b')}),
m AS (SELECT chrom, pos, ref, alts, coalesce(ga, zero) || coalesce(gb, zero) || coalesce(ga, zero) AS gt, CASE WHEN in_a THEN 'third' ELSE 'second' END AS src FROM ab, z)
SELECT chrom, pos, ref, alts, gt, src, CAST(len(list_filter(gt, lambda x: x >= 0)) AS VARCHAR) AS an, nullif(array_to_string(list_transform(alts, lambda a, i: len(list_filter(gt, lambda x: x = i))), ','), '') AS ac FROM m"""


@query(_THREE)
def merge_three(spark, d):
    """Three files in one merge: info of the last one that has the site, counts recomputed."""
    def file(name, src):
        rows = table(spark, d, name).select("site_id", "chrom", "pos", "ref", "alts", "gt", "qual")
        ranked = rows.withColumn("row_idx", F.row_number().over(W.partitionBy("chrom", "pos", "ref", "alts").orderBy("site_id", F.col("qual").asc_nulls_first(), "gt")))
        return ranked.withColumn("info", F.map_from_arrays(F.array(F.lit("SRC")), F.array(F.lit(src))))

    done = merge.merge_files([file("panel_a", "first"), file("panel_b", "second"), file("panel_a", "third")], [16, 16, 16], "strict")
    return done.select("chrom", "pos", "ref", "alts", "gt", F.col("info")["SRC"].alias("src"), F.col("info")["AN"].alias("an"), F.col("info")["AC"].alias("ac"))


def _members(spark, d):
    """Groups of variants: every site of the table, by position, written as lines of a group file."""
    sites = table(spark, d, "variants").where(F.size("alts") > 0).select(F.concat(F.lit("g"), F.col("pos") % 10, F.lit("\t"), "chrom", F.lit(":"), "pos", F.lit("_"), "ref", F.lit("/"), F.get("alts", F.lit(0))).alias("line"))
    return merge.group_members(sites)


_MEMBERS = "(SELECT DISTINCT 'g' || (pos % 10) AS \"group\", chrom, pos, ref, alts[1] AS alt FROM variants WHERE len(alts) > 0 AND alts[1] IS NOT NULL)"
_GROUPED = f"(SELECT DISTINCT m.\"group\", v.row_idx FROM variants v JOIN {_MEMBERS} m ON v.chrom = m.chrom AND v.pos = m.pos AND v.ref = m.ref AND list_contains(v.alts, m.alt))"


@query(f"SELECT \"group\", row_idx FROM {_GROUPED}")
def group_semi_join(spark, d):
    return merge.group_sites(table(spark, d, "variants").select("row_idx", "chrom", "pos", "ref", "alts"), _members(spark, d)).select("group", "row_idx")


@query(_LONG + f"SELECT \"group\", i AS sample_idx, CAST(sum(g) AS DOUBLE) AS burden FROM {_GROUPED} JOIN g USING (row_idx) GROUP BY ALL")
def group_burden(spark, d):
    sites = merge.group_sites(table(spark, d, "variants").select("row_idx", "chrom", "pos", "ref", "alts", "gt").where(F.size("gt") >= _samples(spark, d)), _members(spark, d))
    return merge.burden(sites, assoc.dosages(_samples(spark, d)))


@query(_LONG + "SELECT i AS sample_idx, row_number() OVER (ORDER BY n DESC, i) - 1 AS place FROM (SELECT i, sum(len(list_filter(h, lambda x: x > 0))) AS n FROM h GROUP BY i)")
def sample_sort(spark, d):
    found = order.sample_order(table(spark, d, "variants"), _samples(spark, d))
    return spark.createDataFrame([(s, i) for i, s in enumerate(found)], "sample_idx int, place int")


@query("SELECT sha256(to_json(gt)) AS vector, count(*) AS n_sites, min(row_idx) AS first_row FROM variants WHERE gt IS NOT NULL GROUP BY gt")
def haplotype_classes(spark, d):
    return stats.haplotype_classes(table(spark, d, "variants"))


_ATTR = r"""regexp_extract(regexp_replace(value, '"(\\.|[^"\\])*"', '""', 'g'), '[<,]\s*{0}\s*=\s*([^,>]*)', 1)"""


@query(rf"""SELECT file_id, seq, {_ATTR.format('ID')} AS id, {_ATTR.format('Type')} AS type, {_ATTR.format('Number')} AS number, regexp_extract(value, 'Description\s*=\s*"((\\.|[^"\\])*)"', 1) AS description FROM headers WHERE key IN ('INFO', 'FORMAT')""")
def header_fields(spark, d):
    lines = table(spark, d, "headers").where(F.col("key").isin("INFO", "FORMAT"))
    return H.with_attributes(lines).select("file_id", "seq", "id", "type", "number", "description")


@query(r"SELECT file_id, seq, regexp_replace(regexp_replace(value, ',IDX=[^,>]*', ''), '<IDX=[^,>]*,?', '<') AS value FROM headers")
def header_without_idx(spark, d):
    return table(spark, d, "headers").select("file_id", "seq", H.without_subfield(F.col("value"), "IDX").alias("value"))


@query(f"""WITH k AS (SELECT chrom, ref, alts, gt FROM variants WHERE chrom IN ('chr1', 'chr6', 'chr19') AND pos BETWEEN 1000000 AND 120000000 AND {_atof(_info('DP'))} >= 20),
s AS (SELECT chrom, alts, gt[5:6] || gt[9:10] || gt[21:24] || gt[47:48] AS gt FROM k)
SELECT chrom, count(*) AS n_sites, CAST(sum(list_sum({_AC})) AS BIGINT) AS n_alt, CAST(sum({_AN}) AS BIGINT) AS n_called FROM s GROUP BY chrom""")
def export_pipeline(spark, d):
    """Regions, filter, sample subset, allele statistics and a summary: the flagship."""
    three = [regions.Region(c, 1_000_000, 120_000_000) for c in ("chr1", "chr6", "chr19")]
    rows = regions.in_regions(table(spark, d, "variants"), three).where(filterlang.compile_filter("DP>=20"))
    kept = rows.withColumn("gt", A.subset(F.col("gt"), KEEP, 2))
    ac = F.aggregate("ac", F.lit(0), lambda a, x: a + x)
    return stats.with_allele_stats(kept).groupBy("chrom").agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.when(F.size("ac") > 0, ac)).alias("n_alt"), F.sum("an").alias("n_called"))
