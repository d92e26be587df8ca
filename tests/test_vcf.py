import numpy as np
import pytest
from pyspark.sql import functions as F

from allelora.dataset import Dataset
from allelora.sources import headers as H
from allelora.sources import vcf
from allelora.streaming import stateless

TEXT = """##fileformat=VCFv4.2
##phasing=partial
##contig=<ID=c2,length=500>
##contig=<ID=c1,length=900>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all \\"reads\\"",IDX=3>
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3
c1\t20\trs1\tG\tA,T\t29.5\tPASS\tDP=14;DB;NOTE="a;b"\tGT:GQ:HQ\t0|1:48:5,6\t1/2:4:.\t./.:3:1
c1\t30\t.\tT\t.\t.\t.\t.\tGT\t0\t0|0\t.|1
c2\t25\t.\tC\tCA\t3\tq10;s50\tXX=1\tGT\t0|0\t1|1\t0/1
"""


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vcf") / "a.vcf"
    path.write_text(TEXT)
    return Dataset.read_vcf(spark, str(path), {"GQ": "array<int>", "HQ": "array<int>"})


def test_read(data):
    rows = data.variants.orderBy("row_idx").collect()
    assert data.samples == ("S1", "S2", "S3") and data.phasing == "partial"
    first, second, third = rows
    assert first["alts"] == ["A", "T"] and first["info"] == {"DP": "14", "DB": ".", "NOTE": '"a;b"'}
    assert first["gt"] == [0, 1, 1, 2, -1, -1] and first["ph"] == [1, 0, 0] and first["gq"] == [48, 4, 3]
    assert first["hq"] == [5, 6, None, -2147483647, 1, -2147483647]
    assert second["gt"] == [0, -2147483647, 0, 0, -1, 1] and second["alts"] == [] and second["qual"] is None and second["info"] == {}
    assert second["gq"] is None and third["filters"] == ["q10", "s50"] and third["info"] == {"XX": "1"}


def test_wrong_columns_raise(spark, tmp_path):
    (tmp_path / "b.vcf").write_text(TEXT + "c1\t1\t.\tA\tC\t.\t.\t.\tGT\t0/0\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        Dataset.read_vcf(spark, str(tmp_path / "b.vcf")).variants.collect()


def test_render_is_read_again(data):
    lines = [r["line"] for r in vcf.render(data.variants).orderBy("row_idx").collect()]
    assert lines[0] == 'c1\t20\trs1\tG\tA,T\t29.5\tPASS\tDP=14;DB;NOTE="a;b"\tGT\t0|1\t1/2\t./.'
    assert lines[1] == "c1\t30\t.\tT\t.\t.\t.\t.\tGT\t0\t0|0\t.|1"


def test_header_text(data):
    lines = vcf.header_lines(data.headers, list(data.samples))
    assert lines[4] == '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all \\"reads\\"">'
    assert lines[-1].endswith("FORMAT\tS1\tS2\tS3")


def test_pipeline(data):
    got = data.subset({"S1", "S3", "nobody"}).filter("DP>=10").update_info(("AC", "AN"), "strict").variants.collect()
    assert len(got) == 1 and got[0]["gt"] == [0, 1, -1, -1] and got[0]["info"]["AC"] == "1,0" and got[0]["info"]["AN"] == "2"
    assert data.region("c1:25-", "c2").variants.count() == 2 and data.region("c1:21-29", how="any").variants.count() == 0
    assert [r["pos"] for r in data.sort().variants.collect()] == [25, 20, 30]
    assert data.keep_info(["DP"]).head().where("key = 'INFO'").count() == 1
    assert "gt" not in data.sites_only().variants.columns


def test_rehead(data):
    assert data.rehead(samples=["x", "y", "z"]).samples == ("x", "y", "z")
    with pytest.raises(ValueError):
        data.rehead(samples=["x"])
    with pytest.raises(ValueError):
        data.rehead(headers=data.headers.where("key = 'contig'"))


def rows_of(data):
    return [r.asDict(recursive=True) for r in data.variants.orderBy("row_idx").collect()]


def plain(rows):
    """Rows without NaN, which differs from itself."""
    return [{k: [None if x != x else x for x in v] if isinstance(v, list) else v for k, v in r.items()} for r in rows]


WIDE = """##fileformat=VCFv4.2
##fileDate=20010101
##phasing=partial
##contig=<ID=c1,length=900>
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Quality">
##FORMAT=<ID=HQ,Number=2,Type=Integer,Description="Haplotype quality">
##FORMAT=<ID=POS,Number=.,Type=Float,Description="Named like a column">
##FORMAT=<ID=FT,Number=1,Type=String,Description="Filter">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3
c1\t10\t.\tA\tC,G\t29.5\tPASS\tZ=1;DP=14;DB\tGT:GQ:HQ:FT:XX\t0/1/2:48:5,6:ok:u\t1|2:.:7:.:v\t.:3:.:no:.
c1\t12\trs\tA\t.\t.\t.\tNOTE=5" pipe;DP=1\tGT:POS\t0:0.5,1e-05\t1:.\t.:2
c1\t12\t.\tA\tT\t3\tq10;s50\tAC=3;DP=3;DP=4\tGQ\t1\t2\t.
"""


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wide") / "a.vcf"
    path.write_text(WIDE)
    return Dataset.read(spark, str(path))


def test_all_fields_by_header(wide):
    one, two, three = rows_of(wide)
    end = -2147483647
    assert one["gt"] == [0, 1, 2, 1, 2, end, -1, end, end] and one["ph"] == [0, 0, 1, 0, 0, 0]
    assert one["gq"] == [48, None, 3] and one["hq"] == [5, 6, 7, end, None, end] and one["ft"] == ["ok", None, "no"]
    assert one["undeclared"] == {"XX": ["u", "v", "."]}
    assert wide.variants.where("row_idx = 0").select(F.map_keys("info").alias("k")).first()["k"] == ["Z", "DP", "DB"]
    assert two["gt"] == [0, 1, -1] and two["ph"] == [] and two["format_pos"][:3] == [0.5, pytest.approx(1e-5), None] and two["format_pos"][3] != two["format_pos"][3]
    assert two["info"] == {"NOTE": '5" pipe', "DP": "1"}
    assert three["gt"] is None and three["info"] == {"AC": "3", "DP": "3"} and [r["row_idx"] for r in (one, two, three)] == [0, 1, 2]


def test_written_is_read_again(spark, wide, data, tmp_path):
    for i, one in enumerate((wide, data)):
        path = str(tmp_path / f"v{i}")
        one.write_vcf(path, records_per_file=2)
        again = Dataset.read(spark, path)
        if one is data:  # its GQ and HQ aren't declared in the header
            again = Dataset.read_vcf(spark, path, {"GQ": "int", "HQ": "int"})
        assert plain(rows_of(again)) == plain(rows_of(one)) and again.samples == one.samples and again.phasing == one.phasing
        assert [r["row_idx"] for r in again.slice(1, 3).variants.orderBy("row_idx").collect()] == [1, 2]
    dates = {r["key"]: r["value"] for r in Dataset.read_vcf(spark, str(tmp_path / "v0")).head().collect()}
    assert dates["fileDate"] > "20010101"
    wide.subset({"S3", "S1", "nobody"}).sites_only().write_vcf(str(tmp_path / "sites"))
    assert Dataset.read_vcf(spark, str(tmp_path / "sites")).samples == ()


def test_parquet_keeps_the_end(spark, wide, tmp_path):
    wide.write_parquet(str(tmp_path / "p"))
    again = Dataset.read(spark, str(tmp_path / "p"))
    assert again.samples == wide.samples and again.region("c1:11-11", how="any").variants.count() == 0
    assert {r["end_pos"] for r in again.variants.collect()} == {10, 12}


def test_wide_subset(wide):
    got = rows_of(wide.subset({"S3", "S1", "FAKE"}))
    assert got[0]["gt"] == [0, 1, 2, -1, -2147483647, -2147483647] and got[0]["hq"] == [5, 6, None, -2147483647] and got[0]["undeclared"] == {"XX": ["u", "."]}
    assert got[1]["gt"] == [0, -1] and len(got) == 3


def test_files_with_other_samples_raise(spark, tmp_path):
    (tmp_path / "1.vcf").write_text(WIDE)
    (tmp_path / "2.vcf").write_text(WIDE.replace("S1\tS2", "S2\tS1"))
    with pytest.raises(ValueError, match="different samples"):
        Dataset.read_vcf(spark, str(tmp_path / "*.vcf"))
    (tmp_path / "2.vcf").write_text(WIDE)
    both = Dataset.read_vcf(spark, str(tmp_path / "*.vcf"))
    assert sorted(r["row_idx"] for r in both.variants.collect()) == list(range(6)) and both.headers.count() == 10


def test_regions_file(spark, wide, tmp_path):
    (tmp_path / "r.tsv").write_text("c1\t11\t12\nc1\t12\t400\nc9\t1\t5\n")
    counted = {how: wide.regions_file(str(tmp_path / "r.tsv"), how).variants.count() for how in ("beg", "any", "all", "end")}
    assert counted == {"beg": 4, "any": 4, "all": 4, "end": 4}


def test_command_line(spark, tmp_path):
    from allelora.__main__ import run

    (tmp_path / "a.vcf").write_text(TEXT)
    path, out = str(tmp_path / "a.vcf"), lambda name: str(tmp_path / name)
    say = lambda *argv: list(run(spark, list(argv)))
    assert say("head", "-i", path) == ["S1", "S2", "S3"] and say("head", path)[1] == "phasing\tpartial" and say("head", "-O", "vcf", path)[0] == "##fileformat=VCFv4.2"
    assert say("stat", path) == ["n_records\tn_variants\tn_multi", "3\t4\t1"]
    assert say("stat", "-f", "DP>1", "--per-sample", path)[2:] == ["id\tn_het\tn_hom\tn_snp\tn_indel\tn_syn\tn_nonsyn", "S1\t1\t0\t1\t0\t0\t0", "S2\t0\t1\t3\t0\t0\t0", "S3\t0\t0\t0\t0\t0\t0"]
    assert say("stat-index", path)[1:] == ["c1\t1\t2\t20\t30", "c2\t1\t1\t25\t26"]
    assert say("export", "-i", "S2,S1", "-r", "c1", "--generate-info", "AC,AN", "--phasing", "none", path, out("e")) == []
    got = Dataset.read(spark, out("e"))
    rows = rows_of(got)
    assert got.samples == ("S1", "S2") and got.phasing == "none" and [r["info"]["AN"] for r in rows] == ["4", "4"] and rows[0]["gt"] == [0, 1, 1, 2] and rows[0]["ph"] == [0, 0]
    assert got.head().where("value LIKE '<ID=AN,%'").count() == 1 and got.head().first()["key"] == "fileformat"
    say("import", "-c", "1:3", "-m", "DP", path, out("p"))
    assert Dataset.read(spark, out("p")).variants.count() == 2
    with pytest.raises(ValueError):
        say("export", "-c", "1:3", "-r", "c1", path, out("x"))
    say("sort", "-d", "desc", path, out("s"))
    assert [r["pos"] for r in rows_of(Dataset.read(spark, out("s")))] == [30, 20, 25]
    say("concat", path, path, out("c"))
    assert [r["pos"] for r in rows_of(Dataset.read(spark, out("c")))] == [20, 30, 25, 20, 30, 25]
    (tmp_path / "ids").write_text("x\ny\nz\n")
    say("rehead", "-I", out("ids"), path, out("h"))
    assert Dataset.read(spark, out("h")).samples == ("x", "y", "z")
    (tmp_path / "t.tsv").write_text("id\tn\nS1\t3\nS2\t4\n")
    assert say("stat-merge", out("t.tsv"), out("t.tsv")) == ["id\tn", "S1\t6", "S2\t8"]


def test_sniffing(spark, tmp_path):
    import gzip

    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(WIDE.encode()))
    (tmp_path / "b.txt").write_text("something")
    assert Dataset.read(spark, str(tmp_path / "a.vcf.gz")).variants.count() == 3
    for name in ("b.txt", "nothing"):
        with pytest.raises(ValueError):
            Dataset.read(spark, str(tmp_path / name))


def test_header_attributes(spark):
    rows = [('<ID=A,Description="x, ID=no, Type=\\"q\\"",Type=Float,Number=1>',), ("<Number=A,ID=B>",), ("plain",), (None,)]
    got = H.with_attributes(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["id"], r["type"], r["number"]) for r in got] == [("A", "Float", "1"), ("B", None, "A"), (None, None, None), (None, None, None)]
    assert got[0]["description"] == 'x, ID=no, Type=\\"q\\"'


def test_header_union(spark):
    h = lambda rows: spark.createDataFrame(rows, "seq int, key string, value string")
    a = h([(0, "INFO", "<ID=X,Type=Float>"), (1, "source", "s")])
    b = h([(0, "INFO", "<ID=X,Type=Integer>"), (1, "source", "s"), (2, "source", "t")])
    assert sorted((r["key"], r["value"]) for r in H.union([a, b]).collect()) == [("INFO", "<ID=X,Type=Float>"), ("source", "s"), ("source", "t")]


def test_stream(spark, data, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    data.variants.select("row_idx", "alts", "gt", "qual", "filters", "info").write.parquet(source)
    stream = stateless.filtered(stateless.read(spark, source, spark.read.parquet(source).schema), "DP>=10").select("row_idx", "an")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r["an"] for r in spark.read.parquet(out).collect()] == [4]


def test_stream_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-03 00:00:00")], "load_id bigint, t string").select("load_id", F.to_timestamp("t").alias("loaded_at")).write.parquet(source)
    counted = stateless.arrivals(stateless.read(spark, source, spark.read.parquet(source).schema))
    run = counted.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["load_id"], r["n"]) for r in spark.table("arrivals").collect()) == [(1, 2), (2, 1)]


def test_bcf_round_trip(spark, data, tmp_path):
    from allelora.sources import bcf

    text = TEXT.split("#CHROM")[0] + '##INFO=<ID=DB,Number=0,Type=Flag,Description="">\n##INFO=<ID=NOTE,Number=1,Type=String,Description="">\n##INFO=<ID=XX,Number=1,Type=Float,Description="">\n'
    text += "##FILTER=<ID=q10>\n##FILTER=<ID=s50>\n#CHROM" + TEXT.split("#CHROM")[1].split("\n")[0] + "\n"
    rows = [r.asDict() for r in data.variants.orderBy("row_idx").collect()]
    (tmp_path / "a.bcf").write_bytes(bcf.encode(text, rows))
    got = bcf.read(spark, str(tmp_path / "a.bcf"), batch=2).orderBy("row_idx").collect()
    for a, b in zip(got, rows):
        assert all(a[k] == b[k] for k in ("chrom", "pos", "id", "ref", "alts", "qual", "filters", "info", "gt", "ph"))
    assert len(got) == 3
    whole_set = Dataset.read(spark, str(tmp_path / "a.bcf"))
    assert whole_set.samples == ("S1", "S2", "S3") and whole_set.variants.count() == 3
    assert bcf._sample_texts(np.array([5, -128, 7, -127], "i1").tobytes(), 1, 2, 2, 0) == ["5,.", "7"]
    assert bcf._sample_texts(b"abc\0\0\0", 7, 3, 2, 0) == ["abc", "."]
    assert bcf._sample_texts(np.array([1.5], "<f4").tobytes() + np.array([0x7F800001], "<u4").tobytes(), 5, 1, 2, 0) == ["1.5", "."]
    whole = bcf.encode(text, rows)
    import gzip

    with pytest.raises(ValueError):
        list(bcf.decode(gzip.decompress(whole)[:-5]))
    with pytest.raises(ValueError):
        list(bcf.decode(b"VCF"))
    with pytest.raises(ValueError):
        bcf.encode(text, [rows[0] | {"info": {"no": "1"}}])


def test_positional_order(spark):
    import random

    from allelora.operators import pbwt

    rng = random.Random(6)
    rows = [(i, None if i % 7 == 0 else [rng.randrange(-1, 3) for _ in range(6 if i % 5 else 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_idx bigint, gt array<int>")
    laid = pbwt.sort(df, block=16)
    assert {r["row_idx"]: r["gt"] for r in pbwt.unsort(laid, block=16).collect()} == dict(rows)
    two = spark.createDataFrame([(0, [1, 0, 1, 0]), (1, [5, 6, 7, 8])], "row_idx bigint, gt array<int>")
    assert {r["row_idx"]: r["gt"] for r in pbwt.sort(two).collect()} == {0: [1, 0, 1, 0], 1: [6, 8, 5, 7]}
    assert pbwt.sort(df.limit(0)).count() == 0


def test_varints():
    from allelora.functions import varint

    for bits in range(8):
        for value in (0, 1, 5, 127, 128, 300, 2**21, 2**40 + 7):
            prefix = (1 << bits) - 1
            data = varint.encode(value, prefix, bits)
            assert varint.decode(b"x" + data + b"y", 1, bits) == (value, prefix, 1 + len(data))
    with pytest.raises(ValueError):
        varint.decode(b"\x80")
    with pytest.raises(ValueError):
        varint.encode(1, 2, 1)
