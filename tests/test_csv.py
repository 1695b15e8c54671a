"""Splittable CSV reading against Spark's own multiLine reader, and folders of unlike files."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from matfold.functions.text import clean_name_basic
from matfold.sources import csv_records, readers


@pytest.fixture()
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _dir():
    return tempfile.mkdtemp(prefix="matfold-csv-", dir="/tmp")


def _put(path, raw):
    with open(path, "wb") as f:
        f.write(raw if isinstance(raw, bytes) else raw.encode())
    return path


def _whole(spark, path, **options):
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path)


def _bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_breaks_over_many_blocks(small_blocks, end):
    rnd = random.Random(len(end))
    pieces = ["plain", "", "a b", '"x, y"', f'"two{end}lines"', '"say ""hi"""', '""', f'"{end}{end}"', f'"a ""{end}"" b"', "é", '5" pipe', 'in"side"', '"' + f"long {end}" * 60 + '"']
    rows = [f"{k}," + ",".join(rnd.choice(pieces) for _ in range(3)) for k in range(400)]
    rows[17] = ""
    path = _put(os.path.join(_dir(), "a.csv"), f'id,"B, b",C,D{end}' + end.join(rows) + end)
    got = readers.read_csv(small_blocks, path)
    assert got.columns == ["id", "B, b", "C", "D"]
    assert _bag(got) == _bag(_whole(small_blocks, path))
    blocks = csv_records._chained(csv_records._block_reports(csv_records._lines(small_blocks, path, None), ",")).collect()
    assert len(blocks) >= 4 and any(b["inside"] for b in blocks) and not all(b["inside"] for b in blocks)
    assert csv_records._lines(small_blocks, path, None).rdd.getNumPartitions() > 4


def test_without_broadcast_and_other_ends(small_blocks, monkeypatch):
    monkeypatch.setattr(csv_records, "BROADCAST_BLOCKS", 0)
    d = _dir()
    text = "a;b\n" + "".join(f'{k};"x\n{k}"\n' for k in range(300)) + '300;"last'
    path = _put(os.path.join(d, "open.csv"), text)
    got = {r["a"]: r["b"] for r in readers.read_csv(small_blocks, path, sep=";").collect()}
    assert got["7"] == "x\n7" and len(got) == 301 and got["300"].endswith("last")
    one = _put(os.path.join(d, "bom.csv"), b"\xef\xbb\xbfName,X\nq,1")
    assert [tuple(r) for r in readers.read_csv(small_blocks, one).collect()] == [("q", "1")]
    assert readers.read_csv(small_blocks, _put(os.path.join(d, "head.csv"), "a,b\n")).count() == 0


def test_states_of_lines():
    ends = lambda x, inside=False: csv_records.ends_inside(x, inside, b",")
    assert ends(b'a,"b') and ends(b"", True) and ends(b'x""y', True) and ends(b'x","y', True) and ends(b'"""')
    assert not ends(b'a,"b""c",d') and not ends(b'5" pipe,x') and not ends(b'x",y', True) and not ends(b'a,"b"c"d,e') and not ends(b'a,""')


def test_folder_of_unlike_files(small_blocks):
    spark, d = small_blocks, _dir()
    _put(os.path.join(d, "a.csv"), 'Name,"Mw, g*mol-1",CC50\nx,"1,5",12\n"y, z",2,>3\n')
    _put(os.path.join(d, "b.csv"), 'CC50 , Mw. g*mol-1,Extra,Name\n4,3,"q\nr",q\n')
    _put(os.path.join(d, "c.csv"), 'Name,CC50,"mw,g*mol-1"\nMuñoz A,7,4\n'.encode("latin-1"))
    _put(os.path.join(d, "d.csv"), "Name,CC50\nbad � sign ,1\n" + "longé,2\n" * 200)
    _put(os.path.join(d, "Methods.csv"), "Method abbreviation\nMTT\n")
    df = readers.read_csv_dir(spark, d, exclude=["methods.csv"])
    assert df.columns == ["Name", "Mw, g*mol-1", "CC50", "Extra", "source_file"]
    rows = set(map(tuple, df.collect()))
    assert {("x", "1,5", "12", None, "a.csv"), ("y, z", "2", ">3", None, "a.csv"), ("q", "3", "4", "q\nr", "b.csv"),
            ("Muñoz A", "4", "7", None, "c.csv"), ("bad � sign ", None, "1", None, "d.csv")} <= rows
    assert df.where("source_file = 'd.csv'").count() == 201 and df.where(F.col("Name") == "longé").count() == 200
    picks = {"name": readers.Pick(["Name", "Material"], else_first=True), "cc": readers.Pick(["CC50/IC50/EC50, mM", "CC50"], "CC50|IC50"),
             "mw": readers.Pick(["Mw, g*mol-1", "Mw"]), "method": readers.Pick(["Method"])}
    got = readers.read_csv_dir(spark, d, exclude=["methods.csv"], targets=picks)
    assert got.columns == ["name", "cc", "mw", "method", "source_file"]
    assert ("q", "4", "3", None, "b.csv") in set(map(tuple, got.collect()))
    # by pattern, by the first column, and two spellings in one file
    e = _dir()
    _put(os.path.join(e, "x.csv"), 'Compound,IC50 (24 h),Mw,"M,w"\nfoo,9,,8\n')
    _put(os.path.join(e, "y y.csv"), "Material,Name,cc50\nm,n,5\n")
    assert _bag(readers.read_csv_dir(spark, e, targets=picks)) == [("foo", "9", None, None, "x.csv"), ("n", "5", None, None, "y y.csv")]
    assert _bag(readers.read_csv_dir(spark, e).select("Mw", "source_file")) == [("8", "x.csv"), (None, "y y.csv")]
    assert readers.read_csv_dir(spark, e, glob="*.tsv") is None


def test_encodings_per_file(spark):
    d = _dir()
    latin = _put(os.path.join(d, "latin.txt"), "Material\nAcier inoxydable é\n".encode("latin-1"))
    assert readers.needs_latin1(spark, latin) and readers.read_csv_any_encoding(spark, latin).first()[0] == "Acier inoxydable é"
    _put(os.path.join(d, "utf.txt"), "Material\nAcier é�\n")
    assert {r[0] for r in readers.read_csv_any_encoding(spark, d).collect()} == {"Acier inoxydable é", "Acier é�"}
    assert "�" in {r[0][-1] for r in readers.read_csv(spark, latin).collect()}


def test_dimension_and_master_loaders(spark):
    d = _dir()
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("Method", StringType()), StructField("Text", StringType())])
    empty = readers.load_dimension(spark, os.path.join(d, "none.csv"), schema)
    assert empty.columns == ["Method", "Text"] and empty.count() == 0
    path = _put(os.path.join(d, "m.csv"), "Material_Name,Material_ID\nSteel (316l),1\n,2\n")
    got = readers.load_master(spark, path, clean_name_basic)
    assert got.columns == ["Material_Name", "Material_ID", "Clean_Name"]
    assert got.where("Material_ID = '1'").first()["Clean_Name"] == "STEEL (316L)"
    assert readers.load_master(spark, os.path.join(d, "none.csv"), clean_name_basic) is None
    has = _put(os.path.join(d, "h.csv"), "Clean_Name,Material_ID\nA,1\n")
    assert readers.load_master(spark, has, clean_name_basic).first()["Clean_Name"] == "A"
