import numpy as np
import pytest
from pyspark.sql import functions as F

from allelora.operators import assoc, merge, order, regions, stats
from allelora.operators.filterlang import FilterError, compile_filter
from allelora.operators.regions import Region

SITES = "row_idx bigint, chrom string, pos int, id string, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>, gt array<int>, ph array<int>"


@pytest.fixture(scope="module")
def sites(spark):
    eov = -2147483647
    rows = [
        (0, "c2", 100, "a", "A", ["C"], 50.0, ["PASS"], {"DP": "20", "AF": "0.5", "DB": "."}, [0, 1, 1, 1], [1, 0]),
        (1, "c2", 150, None, "AAAA", ["A", "G"], None, [], {"DP": "9", "AF": "0.05,0.9"}, [0, 2, -1, 1], [0, 0]),
        (2, "c1", 120, ".", "G", [], 10.0, ["q10", "s50"], {}, [0, 0, 0, eov], [0, 0]),
        (3, "zz", 5, "b", "G", ["GTT"], float("nan"), ["PASS"], None, None, None),
        (4, "c1", 120, "c", "G", ["T"], 45.009998, ["PASS"], {"AC": "3", "AN": "4", "PASS": "PASS", "s": "it's"}, [1, 1, 0, 1], [1, 1]),
    ]
    return spark.createDataFrame(rows, SITES)


def ids(df):
    return sorted(r["row_idx"] for r in df.select("row_idx").collect())


@pytest.mark.parametrize("text,region", [("c", Region("c")), ("c:5", Region("c", 5, 5)), ("c:5-", Region("c", 5)), ("c:5-9", Region("c", 5, 9)), ("", Region())])
def test_region_text(text, region):
    assert Region.parse(text) == region


def test_bad_region_text():
    with pytest.raises(ValueError):
        Region.parse("c:x-y")


@pytest.mark.parametrize("how,expected", [("beg", [1]), ("any", [1]), ("all", [1]), ("end", [1])])
def test_bounding_points(sites, how, expected):
    assert ids(regions.in_region(sites, Region("c2", 101, 153), how)) == expected


def test_bounding_points_differ(sites):
    r = Region("c2", 151, 152)
    assert [ids(regions.in_region(sites, r, how)) for how in ("beg", "any", "all", "end")] == [[], [1], [], []]
    assert ids(regions.in_region(sites, Region("", 100, 120))) == [0, 2, 4]


def test_regions_keep_duplicates(sites):
    got = regions.in_regions(sites, [Region("c1"), Region("c2", 90, 110), Region("", 100, 120)])
    assert sorted((r["region_ord"], r["row_idx"]) for r in got.collect()) == [(0, 2), (0, 4), (1, 0), (2, 0), (2, 2), (2, 4)]
    assert regions.in_regions(sites, []).count() == 0


def test_region_is_pushed_down(spark, sites, tmp_path):
    sites.write.parquet(str(tmp_path / "v"))
    plan = regions.in_region(spark.read.parquet(str(tmp_path / "v")), Region("c1", 5, 200)).select("row_idx")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(pos,5)" in plan and "EqualTo(chrom,c1)" in plan


def test_join_regions(spark, sites):
    r = spark.createDataFrame([(0, "c1", 0, 200000), (1, "c2", 100, 149), (2, "c9", 1, 2), (3, "c1", 121, 2**62)], "o int, chrom string, start bigint, end bigint")
    assert sorted((x["o"], x["row_idx"]) for x in regions.join_regions(sites, r, bin_size=64).collect()) == [(0, 2), (0, 4), (1, 0)]


@pytest.mark.parametrize("bins", [16, 1 << 16])
def test_join_regions_by_all_points(spark, sites, bins):
    listed = [Region("c1", 119, 120), Region("c2", 151, 152), Region("c2", 1, 153), Region("c2", 100, 1000), Region("zz", 5, 7), Region("c9", 1, 5)]
    table = spark.createDataFrame([(i, r.chrom, r.start, r.end) for i, r in enumerate(listed)], "region_ord int, chrom string, start bigint, end bigint")
    for how in ("beg", "any", "all", "end"):
        expected = sorted((r["region_ord"], r["row_idx"]) for r in regions.in_regions(sites, listed, how).collect())
        got = regions.join_regions(sites, table, how, bin_size=bins)
        assert sorted((r["region_ord"], r["row_idx"]) for r in got.collect()) == expected
    assert regions.join_regions(sites, table.limit(0), "any").count() == 0 and regions.join_regions(sites.limit(0), table, "any").count() == 0
    with pytest.raises(ValueError):
        regions.join_regions(sites, table, "middle")


@pytest.mark.parametrize(
    "text,expected",
    [
        ("", [0, 1, 2, 3, 4]),
        ("DP>=10", [0]),
        ("AF<0.1", [1, 2, 3, 4]),  # absent counts as 0, of several the first
        ("AC>=3;DP>100", [4]),  # ; is no operator
        ("DP>1 && DP>1", []),  # the second & begins an unknown name
        ("FILTER==PASS", [1, 4]),  # an unquoted word is an info key, absent ones are empty
        ("FILTER=='PASS'", [0, 3, 4]),
        ("DB=='.'", [0]),
        ("DB==''&QUAL>20", [4]),
        ("QUAL<1000", [0, 2, 4]),
        ("QUAL=='45.01'", [4]),
        ("FILTER=~'^q|SS$'", [0, 2, 3, 4]),
        ("FILTER!~'SS'", [1, 2]),
        ("DP==20&AF==0.5|AC==3", [0]),  # a & (b | c)
        ("(DP==20&AF==9)|AC==3", [4]),
        ("s=='it\\'s'", [4]),
        ("(AC==3)&DP==20", []),
        ("AC==3) & DP==20", [4]),  # what follows a parenthesis too many is ignored
        ("POS>1", []),  # not addressable
        ("((DP==20)&(AF==0.5))|(AC==3)", [0, 4]),
        ("(DP==20", [0]),  # a bracket left open
        ("DP==20|AC==3&AF==9", [0]),  # a | (b & c)
        ("PASS==\"PASS\" & 'x'!='y'", [4]),
    ],
)
def test_filters(sites, text, expected):
    assert ids(sites.where(compile_filter(text))) == expected


@pytest.mark.parametrize("text", ["DP", "DP=5", "DP>", "DP>5&", "'x>5", "DP>'5", "DP=>5", "(DP>5) x", ">5", "()", "AA=='x' y", "(DP>5)(AC>1)"])
def test_bad_filters(text):
    with pytest.raises(FilterError):
        compile_filter(text)


def test_allele_stats(sites):
    strict = {r["row_idx"]: r for r in stats.with_allele_stats(sites).collect()}
    assert (strict[0]["ac"], strict[0]["an"], strict[0]["mac"], strict[0]["maf"]) == ([3], 4, 3, 0.75)
    assert (strict[1]["ac"], strict[1]["an"], strict[1]["mac"]) == ([1, 1], 3, 1)
    assert (strict[2]["ac"], strict[2]["an"], strict[2]["mac"]) == ([], 3, None)
    assert strict[3]["ac"] is None and strict[3]["an"] is None
    compat = {r["row_idx"]: r for r in stats.with_allele_stats(sites, "compat").collect()}
    assert compat[1]["an"] == 4 and compat[2]["an"] == 4


def test_update_info(sites):
    got = {r["row_idx"]: r["info"] for r in stats.update_info(sites, ("MAC",), "strict").collect()}
    assert got[0]["MAC"] == "3" and got[0]["AF"] == "0.75" and "AC" not in got[0] and got[0]["DP"] == "20"
    assert got[4]["AC"] == "3" and got[3] is None


def test_summaries(spark, sites):
    assert tuple(stats.summary(sites).first()) == (5, 6, 1)
    assert tuple(stats.summary(sites.limit(0)).first()) == (0, 0, 0)
    per = {r["sample_idx"]: tuple(r)[1:] for r in stats.per_sample(sites, 2).collect()}
    assert per[0] == (1, 2, 3, 2, 0, 0) and per[1] == (1, 1, 3, 0, 0, 0)
    bins = {r["ac"]: tuple(r)[1:] for r in stats.per_allele_count(sites).collect()}
    assert bins == {0: (0,) * 4, 1: (0,) * 4, 2: (0,) * 4, 3: (1, 0, 0, 0), 4: (0,) * 4}
    ann = spark.createDataFrame([("C|missense|x",), ("C|synonymous&intron,G|x|y",), ("C",), (None,)], "a string")
    assert [r[0] for r in ann.select(stats.effect_class(F.col("a"))).collect()] == ["nonsyn", "syn", None, None]


def test_orders(spark, sites):
    contigs = spark.createDataFrame([("c1", 1), ("c2", 0), ("c2", 0)], "chrom string, ord int")
    up = [r["row_idx"] for r in order.ranked(sites, contigs).orderBy("rank").collect()]
    assert up == [0, 1, 2, 4, 3] == [r["row_idx"] for r in order.sort_sites(sites, contigs).collect()]
    assert [r["row_idx"] for r in order.ranked(sites, contigs, descending=True).orderBy("rank").collect()] == up[::-1]
    assert order.ranked(sites.limit(0), contigs).count() == 0


def test_concat_checks(sites):
    got = order.concat([sites.select("row_idx", "pos"), sites.select("row_idx", "pos")], [2, 2]).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in got] == list(range(10)) and [r["file_ord"] for r in got] == [0] * 5 + [1] * 5
    with pytest.raises(ValueError):
        order.concat([sites, sites], [2, 3])
    with pytest.raises(ValueError):
        order.concat([sites, sites.drop("id")])


def test_split_and_merge(spark, sites):
    split = {(r["row_idx"], r["alt_idx"]): r["gt"] for r in merge.split_alternatives(sites).collect()}
    assert split[1, 1] == [0, 0, -1, 1] and split[1, 2] == [0, 1, -1, 0] and (2, 1) not in split
    side = lambda rows: spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, gt array<int>")
    got = merge.merge_sites(side([("c", 1, "A", "C", [1, 0]), ("c", 2, "A", "C", [1, 1])]), side([("c", 2, "A", "C", [0, 1, 1])]), 2, 3)
    assert sorted((r["pos"], r["gt"]) for r in got.collect()) == [(1, [1, 0, 0, 0, 0]), (2, [1, 1, 0, 1, 1])]


def test_merge_of_three_files(spark):
    """The last file's info counts, sites that a file has twice meet in order, null keys and vectors are kept, counts are recomputed."""
    cols = "row_idx bigint, chrom string, pos int, ref string, alts array<string>, info map<string,string>, gt array<int>, ac int"
    a = spark.createDataFrame([(0, "c", 1, "A", ["C"], {"X": "a", "AN": "9"}, [1, 0], 7), (1, "c", 1, "A", ["C"], None, [1, 1], 7), (2, None, None, "A", None, {"X": "n"}, None, 7)], cols)
    b = spark.createDataFrame([(0, "c", 1, "A", ["C"], {"X": "b", "Y": "1"}, [0, 1, 1], 7), (1, "c", 1, "A", ["C", "G"], {}, [2, 0, 0], 7)], cols)
    got = sorted(((r["alts"], r["gt"], r["info"]) for r in merge.merge_files([a, b, a], [2, 3, 2]).collect()), key=str)
    new = lambda ac, an, af, mac, maf: {"AC": ac, "AN": an, "AF": af, "MAF": maf}
    assert got == sorted([
        (["C"], [1, 0, 0, 1, 1, 1, 0], {"X": "a", "Y": "1", **new("4", "7", "0.571429", 4, "0.571429")}),
        (["C"], [1, 1, 0, 0, 0, 1, 1], new("4", "7", "0.571429", 4, "0.571429")),
        (["C", "G"], [0, 0, 2, 0, 0, 0, 0], new("0,1", "7", "0,0.142857", 0, "0")),
        (None, [0] * 7, {"X": "n", "AN": "7"}),
    ], key=str)
    assert merge.merge_files([a.limit(0), b.limit(0)], [2, 3]).count() == 0


def test_groups(spark, sites):
    lines = spark.createDataFrame([("g1\tc2:150_AAAA/G\tc2:100_A/C\tbad",), ("g2\tc2:150_AAAA/T",), ("g3",)], "line string")
    found = merge.group_sites(sites, merge.group_members(lines))
    assert sorted((r["group"], r["row_idx"]) for r in found.collect()) == [("g1", 0), ("g1", 1)]
    burden = {r["sample_idx"]: r["burden"] for r in merge.burden(found, assoc.dosages(2)).collect()}
    assert burden == {0: 3.0, 1: 2.0}
    matrix = merge.group_matrix(found, assoc.dosages(2)).collect()
    assert [r["matrix"] for r in matrix] == [[[1.0, 2.0], [2.0, None]]]


def test_regressions(spark):
    x, y = np.array([-2.0, 0, 0, 4]), np.array([-3.0, -1, 2, 3])
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    responses = dict(enumerate(y.tolist()))
    got = assoc.with_p(assoc.regression(df.select(assoc.moments(F.col("x"), responses).alias("m")))).first()
    slope, icept = np.polyfit(x, y, 1)
    rest = y - slope * x - icept
    se = np.sqrt(rest @ rest / 2 / ((x - x.mean()) ** 2).sum())
    assert np.allclose([got["beta"], got["intercept"], got["se"], got["r2"]], [slope, icept, se, np.corrcoef(x, y)[0, 1] ** 2])
    assert 0 < got["pval"] < 1
    from allelora.functions.arrays import to_sparse

    other = assoc.regression(df.select(assoc.sparse_moments(to_sparse(F.col("x")), responses).alias("m"))).first()
    assert np.allclose([other["beta"], other["se"]], [got["beta"], got["se"]])


def test_sparse_regression_with_missing_dosages(spark):
    from allelora.functions.arrays import to_sparse

    df = spark.createDataFrame([([0.0, None, 2.0, 1.0, 0.0, None],), ([None] * 6,), (None,), ([1.0] * 6,)], "x array<double>")
    y = {0: 1.0, 1: 5.0, 2: 4.0, 3: 2.0, 5: 7.0}
    dense = [r["m"] for r in df.select(assoc.moments(F.col("x"), y).alias("m")).collect()]
    sparse = [r["m"] for r in df.select(assoc.sparse_moments(to_sparse(F.col("x")), y).alias("m")).collect()]
    for a, b in zip(dense, sparse):
        assert (a is None) == (b is None) and (a is None or np.allclose([a[k] for k in a.asDict()], [b[k] for k in a.asDict()]))


def test_whole_association_run(spark):
    rng = np.random.default_rng(8)
    hds = rng.random((3, 20)).round(2)
    y, c = rng.normal(size=10), rng.normal(size=10)
    info = [{"AC": "3,1", "AN": "20"}, {"AF": "0.9"}, None]
    df = spark.createDataFrame([(i, "c", i, info[i], h.tolist(), [0] * 20) for i, h in enumerate(hds)] + [(9, "c", 9, {"AC": "5", "AN": "20"}, None, None)], "row_idx bigint, chrom string, pos int, info map<string,string>, hds array<float>, gt array<int>")
    responses, covariates = dict(enumerate(y.tolist())), {i: [v] for i, v in enumerate(c.tolist())}
    got = {r["row_idx"]: r for r in assoc.associate_sites(df, responses, covariates, n_samples=10, min_mac=0.5).collect()}
    left = assoc.residuals(y, c[:, None])
    assert set(got) == {0, 1, 2}
    for i in range(3):
        assert np.isclose(got[i]["beta"], np.polyfit(hds[i].reshape(10, 2).sum(axis=1), left, 1)[0], atol=1e-6)
    assert (got[0]["mac"], got[0]["maf"]) == (3, 0.15) and np.isclose(got[1]["mac"], 2) and np.isclose(got[1]["maf"], 0.1)
    assert assoc.associate_sites(df, responses, field="gt", n_samples=10).where("row_idx < 2").select("beta").distinct().collect()[0][0] is None
    with pytest.raises(ValueError):
        assoc.associate_sites(df.drop("hds", "gt"), responses, n_samples=10)


def test_residuals():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(40, 2))
    y = 2 + c @ [1.0, -3.0] + rng.normal(size=40)
    r = assoc.residuals(y, c)
    assert abs(r.sum()) < 1e-9 and np.allclose(c.T @ r, 0)
    b = (rng.random(40) < 1 / (1 + np.exp(-c[:, 0]))).astype(float)
    r = assoc.residuals_logit(b, c)
    assert np.allclose(np.column_stack([np.ones(40), c]).T @ r, 0, atol=1e-4)


def test_many_covariates(spark):
    rng = np.random.default_rng(3)
    gt = rng.integers(0, 2, size=(3, 40)).tolist()
    y, c = rng.normal(size=20), rng.normal(size=20)
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gt)] + [(9, None), (10, [0] * 40)], "row_idx bigint, gt array<int>")
    got = {r["row_idx"]: r for r in assoc.regress_many(df, dict(enumerate(y.tolist())), {i: [v] for i, v in enumerate(c.tolist())}, 20).collect()}
    for i, g in enumerate(gt):
        x = np.column_stack([np.ones(20), c, np.array(g).reshape(20, 2).sum(axis=1)])
        assert np.isclose(got[i]["beta"], np.linalg.lstsq(x, y, rcond=None)[0][-1])
    assert got[9]["beta"] is None and got[10]["beta"] is None


def test_phenotypes(spark):
    samples = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "sample_idx int, sample_id string")
    pheno = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", float("nan"), 2), ("x", 3.0, 3)], "sample_id string, y double, line int")
    assert [tuple(r) for r in assoc.phenotypes(samples, pheno).collect()] == [(0, "a", 2.0)]
