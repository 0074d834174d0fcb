import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import csv, report, scratch


def write(tmp_path, text, name="data.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_tokens_padding_and_types(spark, tmp_path):
    path = write(tmp_path, " age , salary ,department,flag,note\n30,1000.5, sales ,True,?\n 41 ,NA,-,False,x\n50,3,hr,True,None\n")
    df = csv.load_csv(spark, path, "flag")
    assert df.dtypes == [("age", "bigint"), ("salary", "double"), ("department", "string"), ("flag", "boolean"),
                         ("note", "string")]
    got = [tuple(r) for r in df.orderBy("age").collect()]
    assert got == [(30, 1000.5, "sales", True, None), (41, None, None, False, "x"), (50, 3.0, "hr", True, None)]


def test_whole_numbers_with_gaps_become_double(spark, tmp_path):
    df = csv.load_csv(spark, write(tmp_path, "a,b\n1,1\n,2\n3,3\n"))
    assert dict(df.dtypes) == {"a": "double", "b": "bigint"}


def test_duplicate_names_after_trim(spark, tmp_path):
    df = csv.load_csv(spark, write(tmp_path, "feature, feature,feature ,target\n1,2,3,4\n"))
    assert df.columns == ["feature", "feature__duplicate_1", "feature__duplicate_2", "target"]
    assert tuple(df.first()) == (1, 2, 3, 4)


def test_latin1_bytes_and_byte_order_mark(spark, tmp_path):
    df = csv.load_csv(spark, write(tmp_path, "city,n\nMünchen,1\nKöln,2\n", encoding="latin1"))
    assert {r["city"] for r in df.collect()} == {"München", "Köln"}
    df = csv.load_csv(spark, write(tmp_path, "﻿a,b\n1,2\n", "bom.csv"))
    assert df.columns == ["a", "b"]


def test_file_contract(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv.load_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        csv.load_csv(spark, write(tmp_path, "a\n1\n", "data.xlsx"))
    with pytest.raises(ValueError, match="no rows"):
        csv.load_csv(spark, write(tmp_path, "a,b\n", "empty.csv"))
    with pytest.raises(ValueError, match="available columns"):
        csv.load_csv(spark, write(tmp_path, "a,b\n1,2\n"), "target")


def test_folder_of_files(spark, tmp_path):
    folder = str(tmp_path / "many.csv")
    spark.range(100).select("id", (F.col("id") * 0.5).alias(" half ")).repartition(4).write.option("header", True).csv(folder)
    df = csv.load_csv(spark, folder)
    assert df.columns == ["id", "half"] and df.agg(F.sum("half")).first()[0] == 2475.0


def test_report_file_and_tables(spark, tmp_path):
    path = str(tmp_path / "report.json")
    report.write_report(spark, {"a": [1, None], "b": {"c": "ä"}}, path)
    report.write_report(spark, {"a": 2}, path)
    assert json.load(open(path, encoding="utf-8")) == {"a": 2}
    report.write_tables({"x": spark.range(3)}, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out" / "x")).count() == 3
    assert report.report_rows({"x": spark.range(2), "y": spark.range(1)}).count() == 3


class FakeContext:
    def __init__(self):
        self.folder = None

    def getConf(self):
        return {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, conf):
        self.conf, self.sparkContext = conf, FakeContext()


def test_checkpoint_folder_is_the_one_the_session_names():
    session = FakeSession({"spark.checkpoint.dir": "hdfs://shared/run"})
    assert scratch.checkpoint_dir(session) == session.sparkContext.folder == "hdfs://shared/run"
    assert scratch.scratch_path(session, "x").startswith("hdfs://shared/run/x-")


def test_checkpoint_without_a_named_folder(spark):
    assert scratch.checkpointed(spark.range(5)).count() == 5
