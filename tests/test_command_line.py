"""The command line, input checks and provenance."""

from __future__ import annotations


def test_commands(spark, data, tmp_path, capsys):
    from lexiloom.__main__ import main

    assert main(["list"]) == 0 and "token_table" in capsys.readouterr().out.split()
    assert main(["sql", "token_table"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "nothing", data]) == 2
    assert main(["run", "mi_returnflag_linestatus", data, "--to", str(tmp_path / "r"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "r")).count() > 0
    assert main(["check", data]) == 0 and "documents: good" in capsys.readouterr().out


def test_faults_and_provenance(spark, data):
    from lexiloom.operators.provenance import faults, provenance

    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, t string")
    assert faults(df, {"k": "bigint", "t": "int", "u": "string"}, "k") == ["t is string, not int", "no column u", "1 rows without k", "1 values of k come more than once"]
    got = {r["name"]: r for r in provenance(spark, data, ["labels", "benchmark"]).collect()}
    assert got["labels"]["rows"] == spark.read.parquet(f"{data}/labels.parquet").count()
    again = spark.read.parquet(f"{data}/labels.parquet").orderBy("toxic", "doc_id").repartition(7)
    from pyspark.sql import functions as F

    assert got["labels"]["checksum"] == again.agg(F.sum(F.xxhash64(*again.columns).cast("decimal(38,0)")).cast("string")).first()[0]
