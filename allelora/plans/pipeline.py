"""Queries of the data-quality operators (problems 1 to 5) over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelora.operators import badrows, diff, drift, profile, skew
from allelora.session import cut, table

#: The enforced target schema of info, by consistent names.
TARGET = {"NS": "bigint", "DP": "bigint", "AF": "array<double>", "AC": "array<bigint>", "AN": "bigint", "R2": "double", "LOD": "double", "BQ": "double", "DB": "boolean", "H2": "boolean", "AA": "string"}
PANEL_FIELDS = ["pos", "ref", "alts", "qual", "gt"]
SLOTS_PER_SAMPLE = 2


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    headers = table(spark, d, "headers")
    found = drift.changes(headers, table(spark, d, "callset_files"))
    rows = table(spark, d, "variants").select("file_id", "info")
    ingested = drift.ingest(rows, drift.consistent_names(headers), TARGET, declared_only=True)
    return found.unionByName(drift.undeclared(ingested, headers))


def p1_sites(spark: SparkSession, d: str) -> DataFrame:
    """All files' sites in one table: target fields typed, everything else rescued."""
    sites = table(spark, d, "variants").select("row_idx", "file_id", "chrom", "pos", "info")
    return drift.ingest(sites, drift.consistent_names(table(spark, d, "headers")), TARGET)


def p1_promoted(spark: SparkSession, d: str) -> DataFrame:
    """The same table with MQ promoted from the rescued values."""
    names = drift.consistent_names(table(spark, d, "headers"))
    return drift.replay(p1_sites(spark, d), names, "MQ", "double").select("row_idx", "MQ", "rescued")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each chrom with at least 5 % of all rows."""
    per_key = skew.key_summary(table(spark, d, "variants").select("chrom", "pos", "row_idx"), "chrom", ["pos", "row_idx"])
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return per_key.where(F.col("n") * 20 >= total).select("chrom")


def p2_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Per contig: rows, first and last position, called alleles."""
    sites = table(spark, d, "variants").select("chrom", "pos", "row_idx", F.coalesce(F.size(F.filter("gt", lambda x: x >= 0)), F.lit(0)).alias("called"))
    return skew.key_summary(sites, "chrom", ["pos", "row_idx"], min_pos=F.min("pos"), max_pos=F.max("pos"), sum_called=F.sum("called"))


def p2_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Each row's place among its contig's rows by position, and the called alleles before it."""
    sites = table(spark, d, "variants").select("chrom", "pos", "row_idx", F.coalesce(F.size(F.filter("gt", lambda x: x >= 0)), F.lit(0)).cast("bigint").alias("called"))
    return skew.running(sites, "chrom", ["pos", "row_idx"], ("called",)).select("row_idx", "rank", "before_called")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    slots = SLOTS_PER_SAMPLE * table(spark, d, "sample_list").count()
    return profile.checked(table(spark, d, "variants"), table(spark, d, "headers"), slots)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_checked(spark, d))
    return profile.bad_values(rows).unionByName(profile.drifted_loads(profile.load_profile(rows), table(spark, d, "load_baseline")))


def p3_loads(spark: SparkSession, d: str) -> DataFrame:
    rates = profile.load_profile(_checked(spark, d))
    return rates.select("load_id", "field", F.round("null_rate", 6).alias("null_rate"), F.round("mean_value", 4).alias("mean_value"))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_profile(table(spark, d, "variants"))


def p3_masks(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_counts(table(spark, d, "variants"))


def p3_rare(spark: SparkSession, d: str) -> DataFrame:
    return profile.rare_masks(table(spark, d, "variants"))


def p3_dominant(spark: SparkSession, d: str) -> DataFrame:
    return profile.dominant_masks(table(spark, d, "variants"))


def p3_divergence(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_divergence(table(spark, d, "variants"), "load_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, failed = badrows.split(badrows.vcf_rows(table(spark, d, "vcf_lines")), badrows.vcf_rules())
    return failed.select("line_id", F.get("errors", F.lit(0)).alias("reason"))


def p4_sites(spark: SparkSession, d: str) -> DataFrame:
    valid, _ = badrows.split(badrows.vcf_rows(table(spark, d, "vcf_lines")), badrows.vcf_rules())
    return badrows.vcf_sites(valid)


def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons of all failed lines, not the first alone, counted."""
    _, failed = badrows.split(badrows.vcf_rows(table(spark, d, "vcf_lines")), badrows.vcf_rules())
    return failed.select(F.explode("errors").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def p5_differences(spark: SparkSession, d: str) -> DataFrame:
    fields = ["chrom", *PANEL_FIELDS]
    return diff.differences(table(spark, d, "panel_a"), table(spark, d, "panel_b"), "site_id", fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = diff.differences(table(spark, d, "panel_a"), table(spark, d, "panel_b"), "site_id", PANEL_FIELDS)
    return found.where(~F.col("field").isin("extra_in_a", "extra_in_b")).select("site_id", "field")


def p5_assigned(spark: SparkSession, d: str) -> DataFrame:
    """The panels' different rows under a coarser key of two sites each: pairs, and differing fields, of the pairing of least cost."""
    side = lambda name: table(spark, d, name).select(F.floor(F.col("site_id") / 2).alias("k"), *PANEL_FIELDS).distinct()
    pairs = diff.paired(side("panel_a"), side("panel_b"), "k", PANEL_FIELDS).where("a IS NOT NULL AND b IS NOT NULL")
    cost = F.size(F.filter(F.array(*(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in PANEL_FIELDS)), lambda x: x))
    return pairs.groupBy("k").agg(F.sum("copies").alias("pairs"), F.sum(F.col("copies") * cost).alias("cost"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_sites, p1_promoted, p2_found, p2_contigs, p2_ranks, p3_found, p3_loads, p3_profile, p3_masks, p3_rare, p3_dominant,
        p3_divergence, p4_found, p4_sites, p4_reasons, p5_found, p5_differences, p5_assigned,
    )
}

_ATTR = r"""regexp_extract(regexp_replace(value, '"(\\.|[^"\\])*"', '""', 'g'), '[<,]\s*{0}\s*=\s*([^,>]*)', 1)"""
_DECL = f"""
decl AS (
  SELECT file_id, key AS section, id, arg_min(type, seq) AS type, arg_min(number, seq) AS number, arg_min(same, seq) AS same
  FROM (SELECT file_id, seq, key, {_ATTR.format("ID")} AS id, {_ATTR.format("Type")} AS type, {_ATTR.format("Number")} AS number,
    lower(regexp_replace(regexp_extract(value, 'Description\\s*=\\s*"((\\\\.|[^"\\\\])*)"', 1), '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS same
    FROM headers WHERE key IN ('INFO', 'FORMAT')) GROUP BY ALL)
"""
_CHECKED = f"""
WITH {_DECL},
n AS (SELECT 2 * count(*) AS slots FROM sample_list),
entries AS (
  SELECT row_idx, k, v, d.type FROM (SELECT row_idx, file_id, unnest(map_keys(info)) AS k, unnest(map_values(info)) AS v FROM variants) e
  JOIN decl d ON d.file_id = e.file_id AND d.section = 'INFO' AND d.id = e.k),
bad_info AS (
  SELECT DISTINCT row_idx FROM (SELECT row_idx, k, type, unnest(string_split(v, ',')) AS x FROM entries WHERE type IN ('Integer', 'Float'))
  WHERE x <> '.' AND (
    (type = 'Integer' AND NOT regexp_full_match(x, '-?[0-9]+'))
    OR (type = 'Float' AND NOT regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'))
    OR (type = 'Float' AND k = 'AF' AND (TRY_CAST(x AS DOUBLE) < 0 OR TRY_CAST(x AS DOUBLE) > 1))
    OR (type = 'Integer' AND k = 'DP' AND TRY_CAST(x AS DOUBLE) < 0))),
checked AS (
  SELECT v.row_idx, load_id, qual, info, gt,
    coalesce(isnan(qual) OR isinf(qual) OR qual < 0 OR qual > 10000, false) AS bad_qual,
    v.row_idx IN (SELECT row_idx FROM bad_info) AS bad_info,
    coalesce(len(gt) <> slots OR len(list_filter(gt, lambda x: x <> -2147483647 AND (x < -1 OR x > coalesce(len(alts), 0)))) > 0, false) AS bad_gt
  FROM variants v, n),
prof AS (
  SELECT load_id, avg(CASE WHEN qual IS NULL THEN 1.0 ELSE 0.0 END) AS qn, avg(CAST(CASE WHEN NOT bad_qual THEN qual END AS DOUBLE)) AS qm,
    avg(CASE WHEN info IS NULL THEN 1.0 ELSE 0.0 END) AS fn, avg(cardinality(info)) AS fm,
    sum(CASE WHEN NOT bad_gt THEN len(list_filter(gt, lambda x: x = -1)) END) / nullif(sum(CASE WHEN NOT bad_gt THEN len(list_filter(gt, lambda x: x <> -2147483647)) END), 0) AS gn,
    sum(CASE WHEN NOT bad_gt THEN list_sum(list_filter(gt, lambda x: x >= 0)) END) / nullif(sum(CASE WHEN NOT bad_gt THEN len(list_filter(gt, lambda x: x >= 0)) END), 0) AS gm
  FROM checked GROUP BY load_id),
loads AS (SELECT load_id, 'qual' AS field, qn AS null_rate, qm AS mean_value FROM prof UNION ALL SELECT load_id, 'info', fn, fm FROM prof UNION ALL SELECT load_id, 'gt', gn, gm FROM prof)
"""
_MASK = r"regexp_replace(translate(regexp_replace(regexp_replace(v, '[0-9]+', '9', 'g'), '[a-df-zA-DF-Z]+', 'a', 'g'), 'E', 'e'), '\s+', ' ', 'g')"
_TEXT = "CASE WHEN isnan({0}) THEN 'nan' WHEN {0} = 'inf' THEN 'inf' WHEN {0} = '-inf' THEN '-inf' ELSE printf('%.6g', CAST({0} AS DOUBLE)) END"
_PLAIN = {c: f"CAST({c} AS VARCHAR)" for c in ("row_idx", "file_id", "load_id", "chrom", "pos", "id", "ref")} | {"qual": _TEXT.format("qual")}
_PLAIN |= {c: f"CAST(CAST({c} AS TIMESTAMP) AS VARCHAR)" for c in ("called_at", "loaded_at")}
_VALUES = " UNION ALL ".join(
    [f"SELECT load_id, '{c}' AS \"column\", {text} AS v FROM variants" for c, text in _PLAIN.items()]
    + [f"SELECT load_id, '{c}', CAST(x AS VARCHAR) FROM (SELECT load_id, unnest({c}) AS x FROM variants)" for c in ("alts", "filters", "gt", "ph", "gq", "dp")]
    + [f"SELECT load_id, 'hds', {_TEXT.format('x')} FROM (SELECT load_id, unnest(hds) AS x FROM variants)"]
    + ["SELECT load_id, 'info.' || k, v FROM (SELECT load_id, unnest(map_keys(info)) AS k, unnest(map_values(info)) AS v FROM variants)"]
)
_MASKS = f"""
WITH v AS ({_VALUES}), m AS (SELECT "column", {_MASK} AS mask, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL)
"""
_MINED = _MASKS + """SELECT "column", mask, n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, sum(n) OVER (PARTITION BY "column" ORDER BY n DESC, mask ROWS UNBOUNDED PRECEDING) - n AS before FROM m)
WHERE before {0} 0.95 * total"""
_LINES = r"""
WITH clean AS (SELECT line_id, file_no, line_no, regexp_replace(line, '\r$', '') AS line FROM vcf_lines),
heads AS (SELECT file_no, arg_min(len(string_split(line, chr(9))), line_no) AS width FROM clean WHERE line LIKE '#CHROM%' GROUP BY file_no),
cells AS (SELECT line_id, c.file_no, line, string_split(line, chr(9)) AS f, width FROM clean c LEFT JOIN heads USING (file_no) WHERE line IS NULL OR line NOT LIKE '#CHROM%'),
errs AS (
  SELECT *, [
    coalesce(len(f) <> width, true),
    coalesce((length(replace(line, '\"', '')) - length(replace(replace(line, '\"', ''), '"', ''))) % 2 = 1, false),
    NOT coalesce(regexp_full_match(f[2], '[0-9]+') AND TRY_CAST(f[2] AS HUGEINT) BETWEEN 1 AND 2147483647, false),
    len(list_filter(f[10:], lambda c: NOT (regexp_full_match(split_part(c, ':', 1), '(\.|[0-9]+)([/|](\.|[0-9]+))?')
      AND len(list_filter(string_split_regex(split_part(c, ':', 1), '[/|]'), lambda a: a <> '.' AND coalesce(TRY_CAST(a AS HUGEINT), 999999999) > CASE WHEN f[5] = '.' THEN 0 ELSE len(string_split(f[5], ',')) END)) = 0))) > 0
  ] AS e FROM cells)
"""
_PANELS = """
WITH a AS (SELECT DISTINCT site_id, chrom, pos, ref, alts, qual, gt FROM panel_a), b AS (SELECT DISTINCT site_id, chrom, pos, ref, alts, qual, gt FROM panel_b),
j AS (SELECT coalesce(a.site_id, b.site_id) AS site_id, a.site_id AS x, b.site_id AS y, {0} FROM a FULL JOIN b ON a.site_id = b.site_id)
SELECT site_id, 'missing_in_b' AS field FROM j WHERE y IS NULL UNION ALL SELECT site_id, 'missing_in_a' FROM j WHERE x IS NULL
"""


def _panels(fields: list[str]) -> str:
    text = _PANELS.format(", ".join(f"a.{f} IS DISTINCT FROM b.{f} AS d_{f}" for f in fields))
    return text + "".join(f" UNION ALL SELECT site_id, '{f}' FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND d_{f}" for f in fields)


def _copies(fields: list[str]) -> str:
    """Differences where a key has one distinct row on a side, with numbers of copies."""
    side = lambda t: f"(SELECT site_id, {', '.join(fields)}, count(*) AS n FROM {t} GROUP BY ALL)"
    text = f"WITH j AS (SELECT coalesce(a.site_id, b.site_id) AS site_id, a.n AS x, b.n AS y, {', '.join(f'a.{f} IS DISTINCT FROM b.{f} AS d_{f}' for f in fields)} FROM {side('panel_a')} a FULL JOIN {side('panel_b')} b ON a.site_id = b.site_id) "
    text += "SELECT site_id, 'missing_in_b' AS field, x AS copies FROM j WHERE y IS NULL UNION ALL SELECT site_id, 'missing_in_a', y FROM j WHERE x IS NULL"
    text += " UNION ALL SELECT site_id, 'extra_in_a', x - y FROM j WHERE x > y UNION ALL SELECT site_id, 'extra_in_b', y - x FROM j WHERE y > x"
    return text + "".join(f" UNION ALL SELECT site_id, '{f}', least(x, y) FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND d_{f}" for f in fields)


def _typed(field: tuple[str, str]) -> str:
    name, kind = field
    if kind == "boolean":
        return f"w.\"{name}\" IN ('.', '1', '')"
    one = lambda v, t: f"TRY_CAST(CASE WHEN {v} <> '.' THEN {v} END AS {t})"
    base = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}[kind.removeprefix("array<").removesuffix(">")]
    return f"list_transform(string_split(w.\"{name}\", ','), lambda x: {one('x', base)})" if kind.startswith("array") else one(f'w."{name}"', base)


_ONE = {"bigint": r"(\.|[+-]?[0-9]{1,18})", "double": r"(\.|[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", "string": "[^,]*", "boolean": r"(\.|1|0|)"}
_FITS = {k: (rf"{_ONE[k[6:-1]]}(,{_ONE[k[6:-1]]})*" if k.startswith("array") else _ONE[k]) for k in TARGET.values()}
_SITES = f"""
WITH {_DECL},
ids AS (SELECT file_id, id, coalesce(nullif(same, ''), chr(1) || id) AS same FROM decl WHERE section = 'INFO'),
best AS (SELECT same, id AS name FROM (SELECT same, id, row_number() OVER (PARTITION BY same ORDER BY count(*) DESC, id) AS r FROM ids GROUP BY same, id) WHERE r = 1),
names AS (SELECT file_id, id, name FROM ids JOIN best USING (same)),
target(name, pattern) AS (VALUES {', '.join(f"('{t}', '{_FITS[k]}')" for t, k in TARGET.items())}),
entries AS (SELECT row_idx, e.k, coalesce(n.name, e.k) AS name, e.val FROM (SELECT row_idx, file_id, unnest(map_keys(info)) AS k, unnest(map_values(info)) AS val FROM variants) e LEFT JOIN names n ON n.file_id = e.file_id AND n.id = e.k),
marked AS (SELECT e.*, coalesce(regexp_full_match(val, pattern), false) AS ok FROM entries e LEFT JOIN target USING (name)),
numbered AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY row_idx, name, ok ORDER BY k) END AS r FROM marked),
wide AS (SELECT row_idx, {', '.join(f"max(CASE WHEN r = 1 AND name = '{t}' THEN val END) AS " + chr(34) + t + chr(34) for t in TARGET)} FROM numbered GROUP BY row_idx),
left_over AS (SELECT row_idx, k, name, val FROM numbered WHERE r IS DISTINCT FROM 1),
saved AS (SELECT row_idx, '{{' || string_agg(to_json(k) || ':' || to_json(val), ',' ORDER BY k) || '}}' AS json FROM left_over GROUP BY row_idx)
"""

_WHOLE = "count(*) AS n_rows, count(*) - count({0}) AS n_null"
_PLAIN_PROFILE = "SELECT '{1}' AS \"column\", " + _WHOLE + ", 0 AS n_nan, 0 AS n_infinite, count(DISTINCT {0}) AS n_distinct, CAST(min({0}) AS VARCHAR) AS least, CAST(max({0}) AS VARCHAR) AS greatest FROM {2}"
#: A number as Java writes it: from 1e7 on, and below 1e-3, with an exponent.
_JAVA = "CASE WHEN abs({0}) >= 1e7 OR (abs({0}) < 1e-3 AND {0} <> 0) THEN CAST(CAST({0} / power(10, floor(log10(abs({0})))) AS FLOAT) AS VARCHAR) || 'E' || CAST(CAST(floor(log10(abs({0}))) AS INTEGER) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
_FLOAT_PROFILE = (
    "SELECT '{1}', n_rows, n_null, n_nan, n_infinite, n_distinct, " + _JAVA.format("low") + ", " + _JAVA.format("high")
    + " FROM (SELECT " + _WHOLE + ", count(*) FILTER (WHERE isnan({0})) AS n_nan, count(*) FILTER (WHERE isinf({0})) AS n_infinite, count(DISTINCT {0}) AS n_distinct, min({0}) FILTER (WHERE isfinite({0})) AS low, max({0}) FILTER (WHERE isfinite({0})) AS high FROM {2})"
)
_SIZE_PROFILE = "SELECT '{0}', " + _WHOLE + ", 0, 0, count(DISTINCT {0}), CAST(min(len({0})) AS VARCHAR), CAST(max(len({0})) AS VARCHAR) FROM variants"
_LISTS = ("alts", "filters", "gt", "ph", "gq", "dp")
_PROFILE = " UNION ALL ".join(
    [_PLAIN_PROFILE.format(c, c, "variants") for c in ("row_idx", "file_id", "load_id", "chrom", "pos", "id", "ref")]
    + [_PLAIN_PROFILE.format(c, c, f"(SELECT CAST({c} AS TIMESTAMP) AS {c} FROM variants)") for c in ("called_at", "loaded_at")]
    + [_FLOAT_PROFILE.format("qual", "qual", "variants"), _FLOAT_PROFILE.format("x", "hds[]", "(SELECT unnest(hds) AS x FROM variants)")]
    + [_SIZE_PROFILE.format(c) for c in (*_LISTS, "hds")]
    + [_PLAIN_PROFILE.format("x", f"{c}[]", f"(SELECT unnest({c}) AS x FROM variants)") for c in _LISTS]
    + [
        "SELECT 'info', " + _WHOLE.format("info") + ", 0, 0, count(DISTINCT list_sort(map_entries(info))), CAST(min(cardinality(info)) AS VARCHAR), CAST(max(cardinality(info)) AS VARCHAR) FROM variants",
        r"""SELECT 'info.' || k, (SELECT count(*) FROM variants), (SELECT count(*) FROM variants) - sum(CASE WHEN v IS NOT NULL THEN n ELSE 0 END), sum(CASE WHEN isnan(x) THEN n ELSE 0 END), sum(CASE WHEN isinf(x) THEN n ELSE 0 END), count(v),
  CASE WHEN bool_and(v IS NULL OR v = '.' OR x IS NOT NULL) AND count(x) > 0 THEN first(v ORDER BY x, coalesce(TRY_CAST(v AS DECIMAL(38, 0)), 0), v) FILTER (WHERE isfinite(x)) ELSE min(v) END,
  CASE WHEN bool_and(v IS NULL OR v = '.' OR x IS NOT NULL) AND count(x) > 0 THEN first(v ORDER BY x DESC, coalesce(TRY_CAST(v AS DECIMAL(38, 0)), 0) DESC, v DESC) FILTER (WHERE isfinite(x)) ELSE max(v) END
FROM (SELECT k, v, count(*) AS n, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') OR lower(v) IN ('nan', 'inf', '+inf', '-inf', 'infinity', '-infinity') THEN TRY_CAST(v AS DOUBLE) END AS x
  FROM (SELECT unnest(map_keys(info)) AS k, unnest(map_values(info)) AS v FROM variants) GROUP BY k, v) GROUP BY k""".replace("\\\\", "\\"),
    ]
)

SQL = {
    "p1_found": f"""
WITH {_DECL},
pairs AS (SELECT file_id, before FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY callset ORDER BY made_at, file_id) AS before FROM callset_files) WHERE before IS NOT NULL),
new AS (SELECT p.file_id, d.section, d.id, d.type, d.number, d.same FROM pairs p JOIN decl d ON d.file_id = p.file_id),
old AS (SELECT p.file_id, d.section, d.id, d.type, d.number, d.same FROM pairs p JOIN decl d ON d.file_id = p.before),
added AS (SELECT * FROM new ANTI JOIN old USING (file_id, section, id)),
gone AS (SELECT * FROM old ANTI JOIN new USING (file_id, section, id)),
moved AS (SELECT a.file_id, a.section, a.id, g.id AS was, a.type <> g.type OR a.number <> g.number AS differs FROM added a JOIN gone g USING (file_id, section, same) WHERE same <> '')
SELECT DISTINCT file_id, section, id AS field, 'renamed' AS change FROM moved
UNION ALL SELECT DISTINCT file_id, section, id, 'type_changed' FROM moved WHERE differs
UNION ALL SELECT n.file_id, n.section, n.id, 'type_changed' FROM new n JOIN old o USING (file_id, section, id) WHERE n.type <> o.type OR n.number <> o.number
UNION ALL SELECT file_id, section, id, 'added' FROM added ANTI JOIN moved USING (file_id, section, id)
UNION ALL SELECT file_id, section, id, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_id = g.file_id AND m.section = g.section AND m.was = g.id)
UNION ALL SELECT DISTINCT file_id, 'INFO', k, 'undeclared' FROM (SELECT file_id, unnest(map_keys(info)) AS k FROM variants) v
  WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.file_id = v.file_id AND d.section = 'INFO' AND d.id = v.k)
""",
    "p2_found": "SELECT chrom FROM variants GROUP BY chrom HAVING count(*) * 20 >= (SELECT count(*) FROM variants)",
    "p2_contigs": "SELECT chrom, count(*) AS n, min(pos) AS min_pos, max(pos) AS max_pos, CAST(sum(coalesce(len(list_filter(gt, lambda x: x >= 0)), 0)) AS BIGINT) AS sum_called FROM variants GROUP BY chrom",
    "p2_ranks": "SELECT row_idx, row_number() OVER w - 1 AS rank, CAST(sum(c) OVER w - c AS BIGINT) AS before_called FROM (SELECT chrom, pos, row_idx, coalesce(len(list_filter(gt, lambda x: x >= 0)), 0) AS c FROM variants) WINDOW w AS (PARTITION BY chrom ORDER BY pos NULLS FIRST, row_idx)",
    "p3_found": _CHECKED
    + """SELECT 'row' AS scope, row_idx AS ref_id, 'qual' AS field FROM checked WHERE bad_qual UNION ALL SELECT 'row', row_idx, 'info' FROM checked WHERE bad_info
UNION ALL SELECT 'row', row_idx, 'gt' FROM checked WHERE bad_gt UNION ALL SELECT 'load', load_id, field FROM loads l JOIN load_baseline b USING (field)
WHERE abs(l.null_rate - b.null_rate) > 0.1 OR abs(l.mean_value - b.mean_value) > 0.25 * abs(b.mean_value)""",
    "p3_loads": _CHECKED + "SELECT load_id, field, round(null_rate, 6) AS null_rate, round(mean_value, 4) AS mean_value FROM loads",
    "p3_profile": f'SELECT "column", n_rows, CAST(n_null AS BIGINT) AS n_null, CAST(n_nan AS BIGINT) AS n_nan, CAST(n_infinite AS BIGINT) AS n_infinite, n_distinct, least, greatest FROM ({_PROFILE})',
    "p3_masks": _MASKS + 'SELECT "column", mask, n FROM m',
    "p3_rare": _MINED.format(">="),
    "p3_dominant": _MINED.format("<"),
    "p3_divergence": f"""
WITH v AS (SELECT * FROM ({_VALUES}) WHERE "column" <> 'load_id'),
m AS (SELECT load_id, "column", {_MASK} AS mask, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
s AS (SELECT load_id, "column", n / sum(n) OVER (PARTITION BY load_id, "column") AS p, sum(n) OVER (PARTITION BY "column", mask) / sum(n) OVER (PARTITION BY "column") AS q, n FROM m)
SELECT load_id, "column", CAST(sum(n) AS BIGINT) AS n, round((sum(abs(p - q)) + 1 - sum(q)) / 2, 6) AS divergence FROM s GROUP BY load_id, "column"
""",
    "p4_found": _LINES + "SELECT line_id, CASE WHEN e[1] THEN 'column_count' WHEN e[2] THEN 'quoting' WHEN e[3] THEN 'bad_pos' ELSE 'bad_gt' END AS reason FROM errs WHERE e[1] OR e[2] OR e[3] OR e[4]",
    "p4_sites": _LINES
    + r""", parts AS (SELECT *, string_split(f[9], ':') AS format, list_filter(regexp_extract_all(f[8], '([^;"\\]|\\.|"(\\.|[^"\\])*")+'), lambda p: p <> '.') AS entries FROM errs WHERE NOT (e[1] OR e[2] OR e[3] OR e[4])),
named AS (SELECT *, list_transform(entries, lambda p: split_part(p, '=', 1)) AS names FROM parts)
SELECT line_id, file_no, f[1] AS chrom, CAST(f[2] AS INTEGER) AS pos, f[3] AS id, f[4] AS ref, CASE WHEN f[5] = '.' THEN [] ELSE string_split(f[5], ',') END AS alts,
TRY_CAST(nullif(f[6], '.') AS FLOAT) AS qual, CASE WHEN f[7] = '.' THEN [] ELSE string_split(f[7], ';') END AS filters,
map_from_entries(list_transform(list_filter(range(1, len(names) + 1), lambda i: list_position(names, names[i]) = i), lambda i: {'k': names[i], 'v': CASE WHEN contains(entries[i], '=') THEN substr(entries[i], instr(entries[i], '=') + 1) ELSE '.' END})) AS info,
flatten(list_transform(f[10:], lambda c: [CASE WHEN a = '.' THEN -1 WHEN a = '' THEN -2147483647 ELSE CAST(a AS INTEGER) END FOR a IN [split_part(translate(split_part(c, ':', 1), '|', '/'), '/', 1), split_part(translate(split_part(c, ':', 1), '|', '/'), '/', 2)]])) AS gt,
list_transform(f[10:], lambda c: CASE WHEN contains(split_part(c, ':', 1), '|') THEN 1 ELSE 0 END) AS ph,
CASE WHEN list_contains(format, 'GQ') THEN list_transform(f[10:], lambda c: TRY_CAST(string_split(c, ':')[list_position(format, 'GQ')] AS INTEGER)) END AS gq,
CASE WHEN list_contains(format, 'DP') THEN list_transform(f[10:], lambda c: TRY_CAST(string_split(c, ':')[list_position(format, 'DP')] AS INTEGER)) END AS dp
FROM named""",
    "p4_reasons": _LINES + "SELECT reason, count(*) AS n FROM (SELECT unnest(['column_count', 'quoting', 'bad_pos', 'bad_gt']) AS reason, unnest(e) AS x FROM errs) WHERE x GROUP BY reason",
    "p5_found": _panels(PANEL_FIELDS),
    "p5_assigned": f"""WITH a AS (SELECT DISTINCT site_id // 2 AS k, {', '.join(PANEL_FIELDS)} FROM panel_a), b AS (SELECT DISTINCT site_id // 2 AS k, {', '.join(PANEL_FIELDS)} FROM panel_b),
x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, ref, alts, qual, gt) AS i FROM (FROM a EXCEPT FROM b)), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, ref, alts, qual, gt) AS j FROM (FROM b EXCEPT FROM a)),
c AS (SELECT x.k, i, j, {' + '.join(f'CAST(x.{f} IS DISTINCT FROM y.{f} AS INTEGER)' for f in PANEL_FIELDS)} AS cost FROM x JOIN y ON x.k = y.k),
n AS (SELECT k, max(i) AS na, max(j) AS nb FROM c GROUP BY k),
one AS (SELECT k, 1 AS pairs, min(cost) AS cost FROM c JOIN n USING (k) WHERE least(na, nb) = 1 GROUP BY k),
two AS (SELECT p.k, 2 AS pairs, min(p.cost + q.cost) AS cost FROM c p JOIN c q ON p.k = q.k AND p.i < q.i AND p.j <> q.j GROUP BY p.k)
SELECT k, CAST(pairs AS BIGINT) AS pairs, CAST(cost AS BIGINT) AS cost FROM (FROM one UNION ALL FROM two)""",
    "p5_differences": _copies(["chrom", *PANEL_FIELDS]),
    "p1_sites": _SITES
    + "SELECT row_idx, file_id, chrom, pos, "
    + ", ".join(f"{_typed((t, k))} AS \"{t}\"" for t, k in TARGET.items())
    + ", (SELECT json FROM saved s WHERE s.row_idx = v.row_idx) AS rescued FROM variants v LEFT JOIN wide w USING (row_idx)",
    "p1_promoted": _SITES
    + """, mq AS (SELECT row_idx, arg_min(val, k) AS val, min(k) AS k FROM left_over WHERE name = 'MQ' AND regexp_full_match(val, '\\.|[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') GROUP BY row_idx),
rest AS (SELECT row_idx, '{' || string_agg(to_json(l.k) || ':' || to_json(l.val), ',' ORDER BY l.k) || '}' AS json FROM left_over l LEFT JOIN mq USING (row_idx) WHERE l.k IS DISTINCT FROM mq.k GROUP BY row_idx)
SELECT row_idx, TRY_CAST(mq.val AS DOUBLE) AS "MQ", rest.json AS rescued FROM variants LEFT JOIN mq USING (row_idx) LEFT JOIN rest USING (row_idx)""",
}
