import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans.analysis import analyse, analyse_classic, analyse_separately, analyse_union
from plumbline.plans.model import analyse_model, join_folder, join_model, read_model
from plumbline.sources import files, sinks
from plumbline.streaming.arrivals import analyse_arrivals, watch_folder


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return str(path)


def test_csv_header_on_first_line(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id, name ,v\n1,x,1.5\n2,y,\n,,\n")
    df = files.read_csv_sniffed(spark, path)
    assert df.columns == ["id", "name", "v"] and df.count() == 2 and dict(df.dtypes)["v"] == "double"


def test_csv_header_below_a_preamble(spark, tmp_path):
    lines = ["Sales report,,", "", "region,product,amount"] + [f"r{i},p{i},{i}.5" for i in range(30)] + ["Sales report,,"]
    df = files.read_csv_sniffed(spark, write(tmp_path / "b.csv", "\n".join(lines)))
    assert df.columns == ["region", "product", "amount"] and df.count() == 31
    assert dict(df.dtypes)["amount"] == "double" and df.where("region = 'Sales report'").count() == 1


def test_csv_latin1(spark, tmp_path):
    path = write(tmp_path / "c.csv", "city,n\nMálaga,1\nKöln,2\n", "latin-1")
    assert files.detect_encoding(spark, path) == "ISO-8859-1"
    assert {r["city"] for r in files.read_csv_sniffed(spark, path).collect()} == {"Málaga", "Köln"}
    assert files.detect_encoding(spark, write(tmp_path / "d.csv", "Málaga\n")) == "UTF-8"


def test_json_and_folder(spark, tmp_path):
    write(tmp_path / "recs.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    write(tmp_path / "lines.jsonl", '{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    write(tmp_path / "t.csv", "k,v\na,1\nb,2\n")
    write(tmp_path / "short.csv", "k,v\na,1\n")
    tables = files.read_tables(spark, str(tmp_path))
    assert {k: t.count() for k, t in tables.items()} == {"recs": 2, "lines": 3, "t": 2}


def test_tables_side_by_side(spark, tmp_path):
    text = "\n".join([
        "PID,Product,Category,,SPID,Person,,GID,Geo", "P01,Bar,Sweet,,SP01,Ann,,G1,NZ", "P02,Box,Sour,,SP02,Bob,,,",
        "P03,Bag,Sweet,,,,,G2,UK"])
    got = files.split_side_by_side(spark, write(tmp_path / "dims.csv", text))
    assert {k: (t.columns, t.count()) for k, t in got.items()} == {
        "PID": (["PID", "Product", "Category"], 3), "SPID": (["SPID", "Person"], 2), "GID": (["GID", "Geo"], 2)}


def test_tidy(spark):
    df = spark.createDataFrame([(1, None, None), (None, None, None)], "` a ` int, `Unnamed: 1` string, `Unnamed: 2` int")
    assert files.tidy(df).columns == ["a"] and files.tidy(df).count() == 1
    held = df.withColumn("Unnamed: 2", F.lit(3))
    assert files.tidy(held).columns == ["a", "Unnamed: 2"] and files.tidy(held, drop_all_unnamed=True).columns == ["a"]


def measured(spark, n=60):
    return spark.range(n).select(
        F.col("id").alias("t"), (F.col("id") * 2.0 + 1).alias("lin"), (F.col("id") * F.col("id") % 17).cast("double").alias("noise"),
        F.when(F.col("id") % 10 != 3, F.col("id") * -1.0).alias("holed"), F.when(F.col("id") % 3 == 0, 1.0).alias("sparse"),
        F.when(F.col("id") % 4 == 0, "a ").otherwise("b").alias("kind"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).cast("string").alias("day"))


def test_full_analysis(spark, tmp_path):
    report = analyse(measured(spark), "demo", ["t"])
    assert report.status == "OK" and report.blocked == ["sparse"]
    assert report.roles.index == ["t"] and report.roles.numeric == ["lin", "noise", "holed"] and report.roles.date == ["day"]
    for name in report.tables:
        assert report.tables[name].columns, name
    assert report.tables["cleaned"].where("holed IS NULL").count() == 0
    assert report.tables["insights"].where("type = 'correlation'").count() == 1
    sinks.write_report({k: report.tables[k] for k in ("statistics", "outliers", "insights", "strong_pairs", "categories")},
                       str(tmp_path / "report"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "report" / "statistics"))
    assert back.columns == list(sinks.STATISTICS_COLUMNS) and back.count() == 3
    sinks.write_table(report.tables["cleaned"], str(tmp_path / "clean"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "clean")).count() == 60
    assert sinks.raw_extract(report.tables["cleaned"], ["t"], 7).count() == 7


def test_analysis_stops_at_a_gate(spark):
    report = analyse(spark.range(3), "tiny")
    assert report.status == "BLOCKED" and "3 rows are too few" in report.stop_reason
    assert report.tables["trace"].where("status = 'BLOCK'").count() == 1


def test_classic_analysis(spark):
    report = analyse_classic(measured(spark), "demo", ["t"], as_of="2020-01-15 00:00:00")
    for name in report.tables:
        assert report.tables[name].columns, name
    assert report.tables["checks"].where("check = 'future_date' AND status = 'WARN'").count() == 1
    assert report.tables["insights"].where("type = 'prediction' AND priority = 'high'").count() >= 1
    assert "lin_zscore" in report.tables["featured"].columns and report.tables["featured"].count() == 60
    counts = {r["item"]: r["count"] for r in report.tables["report_counts"].collect()}
    assert counts["rows"] == 60 and counts["insights_high"] >= 1


def test_text_only_table(spark):
    df = spark.range(12).select(F.concat(F.lit("w"), (F.col("id") % 5).cast("string")).alias("word"))
    report = analyse(df, "words")
    assert report.status == "OK" and "statistics" not in report.tables and report.tables["categories"].count() == 5


def model_tables(spark):
    return {
        "shipments": spark.range(80).select(
            F.concat(F.lit("P"), (F.col("id") % 4).cast("string")).alias("PID"), F.concat(F.lit("G"), (F.col("id") % 3).cast("string")).alias("GID"),
            (F.col("id") * 10.5 + 3).alias("Amount"), (F.col("id") % 7 + 1).cast("int").alias("Boxes"),
            F.date_add(F.lit("2021-01-01"), F.col("id").cast("int")).alias("Shipdate")),
        "products": spark.createDataFrame([(f"P{i}", f"bar {i}", 3.0 + i) for i in range(4)], "PID string, Product string, Cost_per_box double"),
        "locations": spark.createDataFrame([(f"G{i}", f"land {i}", "here") for i in range(3)], "GID string, Geo string, Region string"),
    }


def test_model_flow(spark):
    model, report = analyse_model(model_tables(spark), ["Shipdate"])
    assert model.fact == "shipments" and [d.name for d in model.dims] == ["products", "locations"]
    assert {"Product", "Geo", "Cost", "Profit", "Profit_Pct"} <= set(model.df.columns)
    assert model.relationships().where("orphans = 0").count() == 2
    assert model.schema().where("is_id").count() == 2
    assert {r["column"] for r in model.measures().collect()} >= {"Amount", "Boxes", "Profit", "Profit_Pct"}
    assert report.tables["top_products"].count() == 4 and report.tables["monthly_trend"].count() == 3
    assert report.tables["kpis"].where("label = 'Total Profit'").count() == 1
    assert join_model({"words": spark.createDataFrame([("a",)], "w string")}).fact is None


def test_separate_and_union(spark):
    tables = {"a": measured(spark).select("t", "lin"), "b": measured(spark, 10).select("t", "noise")}
    apart = analyse_separately(tables, {"a": ["t"], "b": ["t"]})
    assert {k: r.status for k, r in apart.items()} == {"a": "OK", "b": "OK"}
    together = analyse_union(tables)
    assert together.status == "OK" and together.tables["cleaned"].count() == 70


def test_arrivals(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    measured(spark).write.parquet(source)
    for _ in range(2):
        stream = watch_folder(spark, source, measured(spark).schema)
        analyse_arrivals(stream, out, state, ["t"], sections=("statistics",)).awaitTermination(120)
        measured(spark, 30).write.mode("append").parquet(source)
    got = spark.read.parquet(os.path.join(out, "statistics")).groupBy("batch").agg(F.max("count").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in got] == [60, 60]  # the second batch repeats rows of the first


def test_csv_folder_of_different_files(spark, tmp_path):
    """Plain and larger, with a preamble, in another encoding, with other columns and with quoted line breaks: each file is its own."""
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "id,name\n" + "".join(f"{i},plain {i}\n" for i in range(200)))
    write(folder / "b.csv", "Sales report,\n\nid,name\n500,below\n501,below\n")
    write(folder / "c.csv", "id,name\n600,Málaga\n", "latin-1")
    write(folder / "d.csv", 'id,name,note\n700,x,"two\nlines"\n701,"a ""b""",n\n')
    got = files.read_csv_sniffed(spark, str(folder))
    assert dict(got.dtypes)["id"] == "bigint" and got.columns == ["id", "name", "note"]
    rows = {r["id"]: (r["name"], r["note"]) for r in got.collect()}
    assert len(rows) == 205 and rows[0] == ("plain 0", None) and rows[500] == ("below", None)
    assert rows[600] == ("Málaga", None) and rows[700] == ("x", "two\nlines") and rows[701] == ('a "b"', "n")
    assert [f.encoding for f in files.sniff_files(spark, str(folder))] == ["UTF-8", "UTF-8", "ISO-8859-1", "UTF-8"]


def test_quoted_line_breaks_across_blocks(spark, tmp_path):
    """One file read by many tasks, values crossing one or several block borders and closing and opening in the same block."""
    import csv
    import random
    rnd = random.Random(3)
    want = [(str(i), "\n".join("x" * rnd.randint(0, 30) for _ in range(rnd.choice([1, 1, 2, 5, 40]))), 'q "' * rnd.randint(0, 2)) for i in range(800)]
    path = tmp_path / "q.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["key", "long text", "more"])
        out.writerows(want)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.read_csv_sniffed(spark, str(path), tidy_up=False)
        assert got.rdd.getNumPartitions() > 20
        rows = sorted((str(r["key"]), r["long text"] or "", r["more"] or "") for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert rows == sorted((a, b if b.strip() else "", c) for a, b, c in want)


def test_json_arrays_are_read_by_many_tasks(spark, tmp_path):
    """Arrays on one line and over many, nested values, braces and quotes in strings, records across block borders, records without an array."""
    import random
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice(['{', '}', '[', ']', '"', '\\', 'é', 'x', '\n', ',', ':']) for _ in range(rnd.choice([0, 3, 60, 900])))
    want = [{"id": i, "s": text(), "deep": {"a": [{"b": text()}, {"b": None}], "c": i % 3}, "none": None} for i in range(300)]
    folder = tmp_path / "arrays"
    folder.mkdir()
    write(folder / "one.json", json.dumps(want[:100], ensure_ascii=False))
    write(folder / "many.json", json.dumps(want[100:200], indent=2))
    write(folder / "row.json", "\n".join(json.dumps(w, indent=1) for w in want[200:]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert files.json_records(spark, str(folder)).rdd.getNumPartitions() > 20
        got = files.read_json(spark, str(folder), tidy_up=False)
        rows = {r["id"]: (r["s"], [x["b"] for x in r["deep"]["a"]], r["deep"]["c"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert rows == {w["id"]: (w["s"], [x["b"] for x in w["deep"]["a"]], w["deep"]["c"]) for w in want}
    write(tmp_path / "none.json", "[]")
    assert files.json_records(spark, str(tmp_path / "none.json")).count() == 0


def test_folder_with_dimensions_side_by_side(spark, tmp_path):
    write(tmp_path / "shipments.csv", "ShipID,PID,SPID,Amount\n" + "".join(f"S{i:04d},P{i % 3:02d},SP{i % 2:02d},{i * 10}\n" for i in range(40)))
    write(tmp_path / "sheet.csv", "PID,Product,Category,,SPID,Person\nP00,Bar,Sweet,,SP00,Ann\nP01,Box,Sour,,SP01,Bob\nP02,Bag,Sweet,,,\n")
    tables, fact = read_model(spark, str(tmp_path))
    assert fact == "shipments" and sorted(tables) == ["PID", "SPID", "shipments"]
    joined = join_folder(spark, str(tmp_path))
    assert joined.fact == "shipments" and {d.name for d in joined.dims} == {"PID", "SPID"}
    got = {r["ShipID"]: (r["Product"], r["Person"]) for r in joined.df.collect()}
    assert len(got) == 40 and got["S0004"] == ("Box", "Ann") and got["S0005"] == ("Bag", "Bob")
