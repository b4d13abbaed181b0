import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, gates, merge, profile, roles
from plumbline.operators.features import add_measures
from plumbline.operators.star import Dim, relationships, schema_type, star_join
from plumbline.sources import files


def gate_table(spark, n=100):
    return spark.range(n).select(
        (F.col("id") + 1).cast("int").alias("row_no"),
        F.when(F.col("id") >= n * 0.2, F.col("id") * 1.0).alias("m20"),
        F.when(F.col("id") >= n * 0.2 + 1, F.col("id") * 1.0).alias("m21"),
        F.lit(4.0).alias("const"),
        F.when(F.col("id") < n * 0.71, F.col("id").cast("string")).otherwise("x").alias("numtext"),
        F.when(F.col("id") < n * 0.61, "2020-01-31").otherwise("soon").alias("maybe_date"),
        F.when(F.col("id") < n * 0.60, "2020-01-31").otherwise("soon").alias("not_date"),
        F.lit(None).cast("string").alias("_source"))


def test_column_gates_at_their_limits(spark, rows):
    got = rows(gates.column_gates(gate_table(spark)))
    assert got["m20"]["status"] == "PASS" and got["m21"]["status"] == "BLOCK"
    assert got["const"]["zero_variance"] and got["const"]["status"] == "BLOCK"
    assert "71%" in got["numtext"]["warning"] and got["maybe_date"]["warning"] is None
    assert "_source" not in got


@pytest.mark.parametrize("n, status", [(0, "BLOCK"), (4, "BLOCK"), (5, "PASS")])
def test_min_rows(spark, n, status):
    got = gates.dataset_gates(spark.range(n)).orderBy("position").collect()
    assert got[0]["status"] == status
    assert got[1]["status"] == ("PASS" if status == "PASS" else "SKIPPED")


@pytest.mark.parametrize("nulls, plain, combined", [(600, "PASS", "PASS"), (601, "BLOCK", "PASS"), (750, "BLOCK", "PASS"), (751, "BLOCK", "BLOCK")])
def test_dataset_missing_gate(spark, nulls, plain, combined):
    df = spark.range(1000).select(F.when(F.col("id") >= nulls, 1).alias("v"))
    for flag, want in ((False, plain), (True, combined)):
        assert gates.dataset_gates(df, flag).where("gate = 'dataset_missing'").first()["status"] == want


def test_date_promotion_vote(spark):
    got = roles.promote_dates(gate_table(spark))
    kinds = dict(got.dtypes)
    assert kinds["maybe_date"] == "timestamp" and kinds["not_date"] == "string"
    assert got.where("maybe_date IS NULL").count() == 39
    assert roles.date_votes(gate_table(spark), ["maybe_date"]).where("share > 0.6").count() == 1


def test_index_and_key_detection(spark):
    df = spark.range(10).select(
        F.col("id").alias("counter"), (F.col("id") * 2).alias("even"), F.concat(F.lit("P"), F.col("id").cast("string")).alias("code"),
        F.when(F.col("id") < 6, "S00001").otherwise("other").alias("mixed"), F.lit("x").alias("side"), F.lit("y").alias("user_id"))
    assert roles.detect_ids(df) == ["counter"]
    # The name pattern only has to match a prefix ("sid" in "side"); the strict mode wants the whole name.
    assert roles.detect_keys(df) == ["counter", "code", "mixed", "side", "user_id"]
    assert roles.detect_keys(df, "strict") == ["counter", "code", "mixed", "user_id"]
    assert roles.detect_ids(df.limit(5)) == []
    assert roles.classify(df, blocked=["even"]).numeric == []


def test_cleaning_order_and_log(spark, rows):
    df = spark.createDataFrame(
        [(" a", 1.0, "x"), ("a ", 1.0, "x"), ("a", 1.0, "x"), ("b", None, None), ("c", 4.0, "x"), ("d", 10.0, "y")],
        "pad string, v double, w string")
    cleaned, log = clean.clean(df)
    assert cleaned.count() == 4
    got = {r["pad"]: (r["v"], r["w"]) for r in cleaned.collect()}
    assert got["b"] == (4.0, "x")
    steps = {(r["step"], r["column"]): r["rows"] for r in log.collect()}
    assert steps["Clean:Whitespace", "pad"] == 2 and steps["Clean:Duplicates", "ALL"] == 2
    assert steps["Clean:Impute", "v"] == 1 and steps["Clean:Impute", "w"] == 1


def test_classic_cleaning(spark):
    data = [("Yes", 1, 1.0), ("no", 2, None), ("TRUE", 3, None), (None, 4, None), (None, None, None)]
    df = spark.createDataFrame(data, "flag string, i int, mostly double")
    cleaned, log = clean.clean_classic(df)
    assert cleaned.count() == 4 and dict(cleaned.dtypes)["flag"] == "int"
    steps = {r["step"] for r in log.collect()}
    assert {"Remove empty rows", "High missingness flag", "Standardize boolean", "Clean:Impute"} <= steps
    assert cleaned.where("mostly IS NULL").count() == 3


def test_mode_and_median_fill(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, None), ("b", 3), ("a", 4)], "s string, i int")
    got = clean.impute(df).where("s = 'a' AND i = 2.5")
    assert got.count() == 1
    assert clean.boolean_columns(df) == []


def test_profile_tables(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (2, None, None)], "i int, s string, e double")
    assert profile.completeness(df).first()[0] == 44.44
    assert profile.duplicate_rows(df).first()[0] == 1
    missing = profile.missing_table(df).collect()
    assert [(r["column"], r["missing"]) for r in missing] == [("e", 3), ("s", 2)]
    got = rows(profile.schema_profile(df, order_by=["i"]))
    assert got["i"]["unique"] == 2 and got["s"]["null_pct"] == 66.7 and got["e"]["samples"] is None
    assert profile.completeness(spark.range(0)).first()[0] == 100.0


def shipments(spark):
    fact = spark.createDataFrame(
        [("S1", "P1", "G1", 100.0, 2), ("S2", "P1", "G9", -5.0, 1), ("S3", "P2", None, 0.0, 1), ("S4", "P3", "G1", 50.0, 5)],
        "ShipmentID string, PID string, GID string, Amount double, Boxes int")
    products = spark.createDataFrame([("P1", "Bar", 10.0), ("P2", "Box", 1.0), ("P2", "Box again", 1.0)], "PID string, Product string, Cost_per_box double")
    places = spark.createDataFrame([("G1", "NZ", 1.0), (None, "nowhere", 2.0)], "GID string, Geo string, Amount double")
    return fact, products, places


def test_star_join_fan_out_orphans_nulls_and_clashes(spark):
    fact, products, places = shipments(spark)
    dims = [Dim(products, "PID", name="products", keys=["PID"]), Dim(places, "GID", name="locations", keys=["GID"])]
    joined = star_join(fact, dims)
    assert joined.count() == 5 and "Amount_location" in joined.columns
    assert joined.where("PID = 'P3' AND Product IS NULL").count() == 1
    assert joined.where("GID IS NULL AND Geo IS NOT NULL").count() == 0
    got = {r["dim"]: r for r in relationships(fact, dims).collect()}
    assert (got["products"]["matched"], got["products"]["orphans"], got["products"]["type"]) == (3, 1, "many-to-many")
    assert (got["locations"]["keyed_rows"], got["locations"]["matched"], got["locations"]["type"]) == (3, 2, "many-to-one")


def test_size_of_a_dimension_is_left_to_spark(spark):
    fact, products, _ = shipments(spark)
    joined = star_join(fact, [Dim(products, "PID", name="products", keys=["PID"])])
    assert "ResolvedHint" not in joined._jdf.queryExecution().analyzed().toString()


def test_null_keys_do_not_meet_in_one_task(spark):
    fact = spark.range(2000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN NULL ELSE 1 END AS k")
    dim = spark.createDataFrame([(1, "a"), (None, "b")], "k int, name string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = star_join(fact, [Dim(dim, "k", name="d", keys=["k"])])
        sizes = [r["count"] for r in joined.where("k IS NULL").groupBy(F.spark_partition_id()).count().collect()]
        assert joined.count() == 2000 and joined.where("name = 'a'").count() == 1000
        assert joined.where("name = 'b'").count() == 0 and max(sizes) < 700
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_measures(spark):
    fact, products, _ = shipments(spark)
    got = add_measures(fact.join(products.limit(1), "PID", "left"))
    first = got.where("ShipmentID = 'S1'").first()
    assert (first["Cost"], first["Profit"], first["Profit_Pct"]) == (20.0, 80.0, 80.0)
    assert got.where("Amount <= 0 AND Profit_Pct IS NOT NULL").count() == 0


def test_union_and_schema_type(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, city string, sales double")
    b = spark.createDataFrame([(1, "y", 3), (2, "z", 4)], "id int, city string, visits int")
    got = merge.tagged_union({"north.csv": a, "a long label › two": b})
    assert got.count() == 3 and "id__north.csv" in got.columns and "city__a_long_label__t" in got.columns
    assert got.where("_source = 'north.csv' AND visits IS NULL AND sales = 2.0").count() == 1
    assert schema_type({"a": a, "b": b}) == "relational"
    assert schema_type({"fact sales": a, "product list": b}) == "star_schema" and schema_type({"a": a}) == "single"


def test_heads_of_files_that_begin_with_blank_lines(spark, tmp_path, monkeypatch):
    """Only a few lines a file are numbered; where these hold too few filled ones, more are read."""
    monkeypatch.setattr(files, "HEAD_WIDTH", 5)
    (tmp_path / "a.csv").write_text("\n" * 700 + "name,amount\n" + "".join(f"n{i},{i}\n" for i in range(50)))
    (tmp_path / "b.csv").write_text("name,amount\nx,900\n")
    heads = {f.path.rsplit("/", 1)[1]: f.lines for f in files.sniff_files(spark, str(tmp_path))}
    assert heads["a.csv"][0] == (700, "name,amount") and len(heads["a.csv"]) == files.HEAD_LINES and heads["b.csv"] == [(0, "name,amount"), (1, "x,900")]
    assert files.read_csv_sniffed(spark, str(tmp_path)).agg(F.sum("amount")).first()[0] == 2125
