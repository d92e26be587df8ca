"""Operators for drift, skew, profiles, bad rows and differences on small cases: nulls, ties, repeats, empty tables, clashing names."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelora.operators import badrows, diff, drift, profile, skew

HEADERS = "file_id bigint, seq int, key string, value string"
FILES = "file_id bigint, callset string, made_at int, extra string"


def decl(file_id, *values, section="INFO"):
    return [(file_id, i, section, v) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def headers(spark):
    rows = [
        *decl(7, '<ID=DP,Number=1,Type=Integer,Description="Depth">', '<ID=AF,Number=A,Type=Float,Description="Share">', '<ID=OLD,Number=1,Type=String,Description="Gone">'),
        *decl(3, '<Description="depth.",ID=TD,Type=Float,Number=1>', '<ID=AF,Number=1,Type=Float,Description="Share">', '<ID=AF,Number=A,Type=Float,Description="Share">', '<ID=NEW,Number=1,Type=String,Description="">'),
        *decl(3, '<ID=AF,Number=1,Type=Float,Description="Share">')[:1],
        (3, 9, "contig", "<ID=c>"), (3, 10, "INFO", None), (3, 11, None, "x"),
    ]
    return spark.createDataFrame(rows, HEADERS)


def test_changes(spark, headers):
    files = spark.createDataFrame([(7, "a", 1, ""), (3, "a", 2, ""), (8, "b", 1, None), (9, None, 5, None), (3, "a", 2, "")], FILES)
    got = sorted(tuple(r) for r in drift.changes(headers, files).collect())
    assert got == [(3, "INFO", "AF", "type_changed"), (3, "INFO", "NEW", "added"), (3, "INFO", "OLD", "removed"), (3, "INFO", "TD", "renamed"), (3, "INFO", "TD", "type_changed")]
    assert drift.changes(headers.limit(0), files).count() == 0
    assert drift.changes(headers, files.limit(0)).count() == 0


def test_file_without_header_removes_all(spark, headers):
    files = spark.createDataFrame([(7, "a", 1, ""), (5, "a", 2, "")], FILES)
    assert {r["change"] for r in drift.changes(headers, files).collect()} == {"removed"}


def test_ingest_and_replay(spark, headers):
    rows = [
        (1, 7, {"DP": "5", "AF": "0.5,.", "OLD": "x"}),
        (2, 3, {"TD": "6.5", "AF": "bad", "ZZ": "1"}),
        (3, 3, None),
        (4, 99, {"DP": "."}),
        (5, 7, {"DP": "1", "TD": "2"}),
        (6, 7, {}),
    ]
    sites = spark.createDataFrame(rows, "row_idx bigint, file_id bigint, info map<string,string>").withColumn("names", F.lit("kept"))
    names = drift.consistent_names(headers)
    table = drift.ingest(sites.drop("names"), names, {"DP": "bigint", "AF": "array<double>"})
    got = {r["row_idx"]: r for r in table.collect()}
    assert got[1]["DP"] == 5 and got[1]["AF"] == [0.5, None] and got[1]["rescued"] == '{"OLD":"x"}'
    assert got[2]["DP"] is None and got[2]["AF"] is None and got[2]["rescued"] == '{"AF":"bad","TD":"6.5","ZZ":"1"}'
    assert got[3]["DP"] is None and got[3]["rescued"] is None and got[4]["DP"] is None and got[4]["rescued"] is None
    assert got[5]["DP"] == 1 and got[6]["rescued"] is None
    back = {r["row_idx"]: r for r in drift.replay(table, names, "ZZ", "bigint").collect()}
    assert back[2]["ZZ"] == 1 and back[2]["rescued"] == '{"AF":"bad","TD":"6.5"}' and back[1]["rescued"] == '{"OLD":"x"}' and back[3]["ZZ"] is None
    assert drift.ingest(sites.drop("names").limit(0), names, {"DP": "bigint"}).count() == 0
    with pytest.raises(ValueError):
        drift.ingest(sites.withColumn("dp", F.lit(1)), names, {"DP": "bigint"})


def test_undeclared_fields_are_rescued(spark, headers):
    rows = [(1, 7, {"DP": "5", "TD": "1"}), (2, 3, {"DP": "5", "AF": "bad", "TD": "x"}), (3, 3, None), (4, 99, {"DP": "1"}), (5, None, {"Q": "1"}), (6, 3, {"DP": None})]
    sites = spark.createDataFrame(rows, "row_idx bigint, file_id bigint, info map<string,string>")
    names = drift.consistent_names(headers)
    for keys in (200_000, 0):
        skew.join_shared.__defaults__, old = (keys, 1_000), skew.join_shared.__defaults__
        table = drift.ingest(sites, names, {"DP": "bigint"}, declared_only=True)
        assert {r["row_idx"]: r["DP"] for r in table.collect()} == {1: 5, 2: None, 3: None, 4: None, 5: None, 6: None}
        got = {tuple(r) for r in drift.undeclared(table, headers).collect()}
        skew.join_shared.__defaults__ = old
        assert got == {(7, "INFO", "TD", "undeclared"), (3, "INFO", "DP", "undeclared"), (99, "INFO", "DP", "undeclared"), (None, "INFO", "Q", "undeclared")}


def test_join_shared(spark):
    """A hot key, keys without a map and null keys, joined by broadcast and by shuffle alike; other columns of clashing names stay."""
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"), F.lit("x").alias("value"))
    maps = spark.createDataFrame([(7, {"a": "1"}), (8, {"a": "1"}), (10, {"b": "2", "a": "1"}), (999, {})], "k bigint, m map<string,string>")
    expected = sorted((r["n"], {7: "1", 8: "1", 10: "1"}.get(r["k"])) for r in rows.collect())
    for keys, values in ((100, 100), (1, 100), (100, 1)):
        got = skew.join_shared(rows, maps, "k", "m", max_keys=keys, max_values=values)
        assert got.columns == ["k", "n", "value", "m"] and sorted((r["n"], r["m"] and r["m"]["a"]) for r in got.collect()) == expected
        assert skew.join_shared(rows.limit(0), maps.limit(0), "k", "m", max_keys=keys).count() == 0


def test_two_names_of_one_field(spark):
    h = spark.createDataFrame(decl(1, '<ID=A,Number=1,Type=Integer,Description="d">', '<ID=B,Number=1,Type=Integer,Description="D!">'), HEADERS)
    sites = spark.createDataFrame([(1, 1, {"B": "2", "A": "1"})], "row_idx bigint, file_id bigint, info map<string,string>")
    r = drift.ingest(sites, drift.consistent_names(h), {"A": "bigint"}).first()
    assert r["A"] == 1 and r["rescued"] == '{"B":"2"}'


def skewed(n=3000):
    rng = random.Random(1)
    return [(i, rng.choice([None, "a"] + ["hot"] * 8), rng.choice([None, *range(50)]), rng.randrange(5)) for i in range(n)]


def test_running_splits_and_stitches(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "id bigint, k string, p int, w bigint").repartition(5).withColumn("part_of", F.lit(1))
    ranged = skew.range_partitioned(df, "k", ["p", "id"], 6)
    assert ranged.where("k = 'hot'").select("__part").distinct().count() >= 4
    got = {r["id"]: (r["rank"], r["before_w"]) for r in skew.running(df, "k", ["p", "id"], ("w",), 6).collect()}
    low = lambda x: (x is not None, x or 0)
    for key in (None, "a", "hot"):
        total = 0
        for rank, (i, _, _, w) in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (low(r[2]), r[0]))):
            assert got[i] == (rank, total)
            total += w
    assert skew.running(df.limit(0), "k", ["p", "id"], ("w",)).count() == 0


def test_key_summary(spark):
    rows = skewed(500)
    df = spark.createDataFrame(rows, "id bigint, k string, p int, w bigint")
    got = {r["k"]: (r["n"], r["sum_w"], r["max_p"]) for r in skew.key_summary(df, "k", ["p", "id"], 5, sum_w=F.sum("w"), max_p=F.max("p")).collect()}
    for key in (None, "a", "hot"):
        own = [r for r in rows if r[1] == key]
        assert got[key] == (len(own), sum(r[3] for r in own), max(r[2] for r in own if r[2] is not None))


def test_join_back(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 3 else f"k{i % 50}") for i in range(600)], "id bigint, key string")
    per = rows.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    for heavy in (2, 1000):
        got = {r["id"]: r["first"] for r in skew.join_back(rows, per, "key", "n", heavy).collect()}
        firsts = {r["key"]: r["first"] for r in per.collect()}
        assert got == {r["id"]: firsts.get(r["key"]) for r in rows.collect()}
    assert skew.join_back(rows.limit(0), per.limit(0), "key", "n").count() == 0


def test_masks(spark):
    df = spark.createDataFrame([(v,) for v in ("a12", "1.5e-10", "E", "ab CD\t9", "", "<DEL>", None, "é1")], "v string")
    assert [r[0] for r in df.select(profile.mask(F.col("v"))).collect()] == ["a9", "9.9e-9", "e", "a a 9", "", "<aea>", None, "a9"]


@pytest.mark.parametrize("kind,good,bad", [
    ("Integer", ["1", "-5", ".", "1,.,3", "007"], ["", "+1", "1.0", "1e3", "1,", " 1", "--", "1_0", "a"]),
    ("Float", ["1", "-0.5", "+1.5e-10", ".5", "5.", "1E5", ".", "1,2.5"], ["", "e5", "1e", "1.2.3", "<0.1", "0.1 ", "nan", "1%"]),
    ("String", ["", "x", ","], []), ("Flag", ["", "x"], []), (None, ["anything"], []),
])
def test_types_by_masks(spark, kind, good, bad):
    df = spark.createDataFrame([(v, kind) for v in good + bad], "v string, k string")
    assert [r[0] for r in df.select(profile.fits_type(F.col("v"), F.col("k"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_checked_rows_and_loads(spark, headers):
    schema = "row_idx bigint, file_id bigint, load_id bigint, qual float, info map<string,string>, gt array<int>, alts array<string>"
    rows = [
        (1, 7, 1, 10.0, {"DP": "5", "AF": "0.5"}, [0, 1], ["C"]),
        (2, 7, 1, float("nan"), {"DP": "-5"}, [0, 2], ["C"]),
        (3, 7, 1, float("inf"), {"AF": "1.5"}, [0], ["C"]),
        (4, 7, 2, None, None, None, None),
        (5, 99, 2, 20.0, {"DP": "x"}, [-1, -2147483647], []),
        (6, 7, 2, -1.0, {"AF": "."}, [0, -2], ["C"]),
        (7, 7, 2, 10001.0, {"OLD": "1"}, [], ["C"]),
    ]
    got = profile.checked(spark.createDataFrame(rows, schema), headers, 2)
    bad = sorted((r["ref_id"], r["field"]) for r in profile.bad_values(got).collect())
    assert bad == [(2, "gt"), (2, "info"), (2, "qual"), (3, "gt"), (3, "info"), (3, "qual"), (6, "gt"), (6, "qual"), (7, "gt"), (7, "qual")]
    loads = {(r["load_id"], r["field"]): (r["null_rate"], r["mean_value"]) for r in profile.load_profile(got).collect()}
    assert loads[1, "qual"] == (0, 10) and loads[2, "qual"] == (0.25, 20) and loads[1, "gt"] == (0, 0.5) and loads[2, "gt"] == (1, None) and loads[2, "info"] == (0.25, 1)
    base = spark.createDataFrame([("qual", 0.1, 10.0), ("gt", 0.0, 0.5)], "field string, null_rate double, mean_value double")
    assert sorted((r["ref_id"], r["field"]) for r in profile.drifted_loads(profile.load_profile(got), base).collect()) == [(2, "gt"), (2, "qual")]
    assert profile.load_profile(profile.checked(spark.createDataFrame([], schema), headers, 2)).count() == 0


def test_profile_and_divergence(spark):
    df = spark.createDataFrame([(1, "a1", {"x": "1"}, [1]), (1, "b2", None, []), (2, "9", {"x": "q"}, None), (None, None, {}, [5])], "load bigint, s string, m map<string,string>, a array<int>")
    got = {r["column"]: tuple(r)[1:] for r in profile.profile(df).collect()}
    assert got["s"] == (4, 1, 3, "9", "b2") and got["load"][:3] == (4, 1, 2) and got["a"][3:] == ("0", "1")
    assert profile.profile(df.limit(0)).first()["n_rows"] == 0
    d = {(r["load"], r["column"]): r["divergence"] for r in profile.mask_divergence(df, "load").collect()}
    assert d[1, "s"] == round(1 / 3, 6) and d[2, "s"] == round(2 / 3, 6) and d[None, "a"] == 0
    assert {(r["column"], r["mask"]): r["n"] for r in profile.mask_counts(df.drop("load")).collect()} == {("s", "a9"): 2, ("s", "9"): 1, ("m.x", "9"): 1, ("m.x", "a"): 1, ("a", "9"): 2}


def test_violations_in_columns_of_any_size(spark):
    """Masks beyond those that cover most of a column, in a small column and beside several dominant ones."""
    rows = [("a1",)] * 12 + [("2b",)] * 7 + [("?",)]
    df = spark.createDataFrame(rows, "s string").withColumn("t", F.when(F.col("s") == "?", 1.5)).withColumn("b", F.lit(None).cast("array<float>"))
    assert {tuple(r) for r in profile.dominant_masks(df).collect()} == {("s", "a9", 12, 20), ("s", "9a", 7, 20), ("t", "9.9", 1, 1)}
    assert {tuple(r) for r in profile.rare_masks(df).collect()} == {("s", "?", 1, 20)}
    assert profile.rare_masks(df.limit(0)).count() == 0 and profile.dominant_masks(df.limit(0)).count() == 0
    wide = spark.createDataFrame([(1, [1.5, float("nan"), None], ["x", None], [3, -1, None], True)], "n int, f array<float>, s array<string>, i array<int>, b boolean")
    got = {(r["column"], r["mask"]): r["n"] for r in profile.mask_counts(wide).collect()}
    assert got == {("n", "9"): 1, ("f", "9.9"): 1, ("f", "a"): 1, ("s", "a"): 1, ("i", "9"): 1, ("i", "-9"): 1, ("b", "ae"): 1}


LINES = "line_id bigint, file_no bigint, line_no int, line string, width int"


def test_bad_rows(spark):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2"
    make = lambda pos="5", alt="C,G", info="X=1", s1="0|1", s2="2/.:7": f"c\t{pos}\t.\tA\t{alt}\t.\t.\t{info}\tGT\t{s1}\t{s2}"
    cases = [
        (make(), None), (make() + "\r", None), (make(s1="1"), None), (make(info='A="x;\\"y"'), None), (make(pos="007"), None), (make(pos="2147483647"), None), (make(s1="0001/2"), None),
        ("", "column_count"), (None, "column_count"), (make() + "\tx", "column_count"), (make(info='"'), "quoting"), (make(info='\\""'), "quoting"),
        (make(pos="0"), "bad_pos"), (make(pos="2147483648"), "bad_pos"), (make(pos="99999999999999999999"), "bad_pos"), (make(pos=" 5"), "bad_pos"), (make(pos="-5"), "bad_pos"), (make(pos="٣"), "bad_pos"), (make(pos="5\n"), "bad_pos"),
        (make(s1="3"), "bad_gt"), (make(alt=".", s2="0", s1="1"), "bad_gt"), (make(s1="0/1/1"), "bad_gt"), (make(s1=""), "bad_gt"), (make(s1="0\\1"), "bad_gt"), (make(s1="x"), "bad_gt"), (make(s1="99999999999999"), "bad_gt"),
        (make(pos="x", info='"'), "quoting"), (make(alt=".", s1=".", s2="0|0"), None),
    ]
    rows = [(0, 1, 1, head, 9)] + [(i + 1, 1, i + 2, line, 9) for i, (line, _) in enumerate(cases)] + [(900, 2, 1, make(), 9), (901, 3, 1, "#CHROM\tPOS", 9)]
    df = spark.createDataFrame(rows, LINES)
    valid, failed = badrows.split(badrows.vcf_rows(df), badrows.vcf_rules())
    got = {r["line_id"]: r["errors"][0] for r in failed.collect()}
    assert got == {i + 1: reason for i, (_, reason) in enumerate(cases) if reason} | {900: "column_count"}
    sites = {r["line_id"]: r for r in badrows.vcf_sites(valid).collect()}
    assert set(sites) == {i + 1 for i, (_, reason) in enumerate(cases) if not reason}
    assert sites[1]["gt"] == [0, 1, 2, -1] and sites[3]["gt"][:2] == [1, badrows.EOV] and sites[4]["info"] == {"A": '"x;\\"y"'}
    assert sites[len(cases)]["alts"] == []
    assert sites[1]["ph"] == [1, 0] and sites[1]["gq"] is None and sites[1]["dp"] is None and sites[1]["qual"] is None and sites[1]["filters"] == []
    more = "c\t5\t.\tA\tC\t7.5\tq;r\tX=1;X=2;F\tGT:DP:GQ\t0|1:12:.\t1:x"
    row = badrows.vcf_sites(badrows.split(badrows.vcf_rows(spark.createDataFrame([(0, 1, 1, head, 9), (1, 1, 2, more, 9)], LINES)), badrows.vcf_rules())[0]).first()
    assert (row["dp"], row["gq"], row["qual"], row["filters"], row["info"]) == ([12, None], [None, None], 7.5, ["q", "r"], {"X": "1", "F": "."})
    valid, failed = badrows.split(badrows.vcf_rows(df.limit(0)), badrows.vcf_rules())
    assert valid.count() == 0 and failed.count() == 0


def test_clashing_names(spark):
    """Fields named like the operators' own columns, and a key named like an output column."""
    cols = "copies int, x int, row int, hash string, k int, n_a int"
    a = spark.createDataFrame([(1, 1, 1, "p", 1, 1), (2, 5, 5, "q", 5, 5), (3, 1, 1, "r", 1, 1)], cols)
    b = spark.createDataFrame([(1, 2, 1, "p", 1, 3), (2, 5, 5, "q", 5, 5)], cols)
    got = sorted(tuple(r) for r in diff.differences(a, b, "copies", ["x", "row", "hash", "k", "n_a"], block=0).collect())
    assert got == [(1, "n_a", 1), (1, "x", 1), (3, "missing_in_b", 1)]
    df = spark.createDataFrame([("u", 2, 7, 1), ("u", 1, 8, 1), (None, 3, 9, 1)], "part string, at int, n int, c int")
    assert sorted((r["n"], r["rank"]) for r in skew.running(df, "part", ["at"], ("n",), 2).collect()) == [(7, 1), (8, 0), (9, 0)]
    assert {r["part"]: r["sum_n"] for r in skew.key_summary(df, "part", ["at"], 2, sum_n=F.sum("n")).collect()} == {"u": 15, None: 9}


def brute_cost(costs, supply, demand):
    rows, cols = np.repeat(np.arange(len(supply)), supply), np.repeat(np.arange(len(demand)), demand)
    c = costs[np.ix_(rows, cols)]
    c = c if c.shape[0] <= c.shape[1] else c.T
    return min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(c.shape[1]), c.shape[0]))


def test_assignment_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 4, 2)
        costs = rng.integers(0, 6, (n, m)).astype(float)
        supply, demand = rng.integers(1, 3, n), rng.integers(1, 3, m)
        pairs = diff.assign(costs, supply, demand)
        assert sum(c for *_, c in pairs) == min(supply.sum(), demand.sum())
        assert sum(costs[i, j] * c for i, j, c in pairs) == brute_cost(costs, supply, demand)


PANEL = "id bigint, pos int, ref string, gt array<int>, seen int"


def panels(spark, a, b):
    return spark.createDataFrame([(*r, 1) for r in a], PANEL), spark.createDataFrame([(*r, 2) for r in b], PANEL)


def test_differences(spark):
    a = [(1, 5, "A", [0]), (1, 5, "A", [0]), (2, 6, "A", [1]), (3, None, "A", None), (4, 1, "A", [0]), (6, 1, "A", [0]), (6, 2, "C", [1]), (7, 1, "A", [0]), (7, 1, "A", [0]), (None, 1, "A", [0]), (8, 1, "A", [0]), (8, 1, "A", [0]), (8, 2, "B", [0])]
    b = [(1, 5, "A", [0]), (3, None, "A", None), (4, 2, None, [0, 1]), (5, 1, "A", [0]), (6, 2, "C", [0]), (6, 1, "G", [0]), (7, 1, "T", [0]), (7, 1, "T", [0]), (None, 2, "A", [0])]
    got = {(r["id"], r["field"]): r["copies"] for r in diff.differences(*panels(spark, a, b), "id", ["pos", "ref", "gt"]).collect()}
    assert got == {
        (1, "extra_in_a"): 1, (2, "missing_in_b"): 1, (4, "pos"): 1, (4, "ref"): 1, (4, "gt"): 1, (5, "missing_in_a"): 1, (6, "gt"): 1, (6, "ref"): 1, (7, "ref"): 2, (None, "pos"): 1, (8, "missing_in_b"): 3,
    }
    x, y = panels(spark, a, b)
    assert {r["field"] for r in diff.differences(x, y.limit(0), "id", ["pos", "ref", "gt"]).collect()} == {"missing_in_b"}
    assert diff.differences(x, x, "id", ["pos", "ref", "gt"]).count() == 0
    assert diff.differences(x.limit(0), y.limit(0), "id", ["pos"]).count() == 0


def test_large_keys_by_levels(spark):
    rng = random.Random(2)
    a = [(1, rng.randrange(6), rng.choice("ACG"), [rng.randrange(3)]) for _ in range(60)]
    b = [(1, rng.randrange(6), rng.choice("ACG"), [rng.randrange(3)]) for _ in range(50)]
    x, y = panels(spark, a, b)
    fields = ["pos", "ref", "gt"]
    small, large = diff.paired(x, y, "id", fields), diff.paired(x, y, "id", fields, block=2)
    count = lambda df, c: df.where(c).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    both = "a IS NOT NULL AND b IS NOT NULL"
    assert count(small, both) == count(large, both)
    assert count(small, "b IS NULL") == count(large, "b IS NULL") == count(small, both) * 0 + count(small, "b IS NULL")
    assert count(large, "a IS NULL") == count(small, "a IS NULL")


def test_large_keys_at_minimum_cost(spark):
    fields, rng = ["pos", "ref", "alt", "q", "g"], random.Random(5)
    text = lambda s: (*map(int, s),)
    draw = lambda n: [tuple(rng.randrange(3) for _ in fields) for _ in range(n)]
    schema = "id bigint, pos int, ref int, alt int, q int, g int"
    a = [(1, *text("11111")), (1, *text("21122")), *((2, *r) for r in draw(14)), *((None, *r) for r in draw(9)), (3, *text("11111")), (3, *text("21122"))]
    b = [(1, *text("21111")), (1, *text("12211")), *((2, *r) for r in draw(10)), *((None, *r) for r in draw(12)), (3, *text("21111")), (3, *text("12211")), (3, *text("12212"))]
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)

    def costs(block):
        out = {}
        for r in diff.paired(x, y, "id", fields, block).collect():
            c, n = out.get(r["id"], (0, 0))
            both = r["a"] is not None and r["b"] is not None
            out[r["id"]] = c + both * r["copies"] * sum(u != v for u, v in zip(r["a"] or (), r["b"] or ())), n + r["copies"] * both
        return out

    exact, large = costs(200), costs(1)
    assert exact == large and large[1] == (4, 2)
    one = lambda block: {(r["field"], r["copies"]) for r in diff.differences(x, y, "id", fields, block).where("id = 1").collect()}
    assert one(1) == one(200) == {("ref", 1), ("alt", 1), ("q", 1), ("g", 1)}


def test_profile_of_values(spark):
    many = {"DP": "10"}
    rows = [(i, 5.0 + i % 2, many if i % 2 else {"DP": "9", "AA": "x"}, [0, -9], i) for i in range(2000)] + [(2000, float("nan"), {"DP": "."}, [255], 0), (2001, float("inf"), None, None, 2**60 + 1), (2002, None, {}, [None], 2**60)]
    df = spark.createDataFrame(rows, "row bigint, qual float, info map<string,string>, gt array<int>, big bigint")
    got = {r["column"]: tuple(r)[1:] for r in profile.value_profile(df).collect()}
    assert got["row"] == (2003, 0, 0, 0, 2003, "0", "2002")
    assert got["qual"] == (2003, 1, 1, 1, 4, "5.0", "6.0")
    assert got["gt[]"] == (4002, 1, 0, 0, 3, "-9", "255") and got["gt"] == (2003, 1, 0, 0, 3, "1", "2")
    assert got["info.DP"] == (2003, 2, 0, 0, 3, "9", "10") and got["info.AA"] == (2003, 1003, 0, 0, 1, "x", "x") and got["info"][:2] == (2003, 1)
    assert got["big"][4:] == (2002, "0", str(2**60 + 1))
    empty = {r["column"]: tuple(r)[1:] for r in profile.value_profile(df.limit(0)).collect()}
    assert set(empty) == {"row", "qual", "info", "gt", "gt[]", "big"} and set(empty.values()) == {(0, 0, 0, 0, 0, None, None)}
