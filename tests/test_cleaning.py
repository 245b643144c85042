from __future__ import annotations

import pytest
from frames import day, raw
from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.functions.expressions import category_of, tidy_text
from patronage.operators import clean as C
from patronage.operators import validate as V
from patronage.sources import invoices as I
from patronage.sources import invoices

FILLER = [(f"9{i}", "F", "FILLER ITEM", 1 + i % 5, "2011-02-01", 2.0, 100 + i, "UK") for i in range(80)]
CASE = [("1", "A", "mug  red", 1, "2011-01-01", 1.0, 1, "UK"), ("1", "A", "mug  red", 1, "2011-01-01", 1.0, 1, "UK"),
        ("2", "A", "Mug Red", 2, "2011-01-01", 1.0, 1, "UK"), ("C3", "A", "MUG RED", -2, "2011-01-01", 1.0, 1, "UK"),
        ("4", "POST", "postage", 1, "2011-01-02", 15.0, 1, "UK"), ("5", "B", "x", 3, "2011-01-03", 0.0, None, "UK"),
        ("6", "C", "Candle", 90000, "2011-01-04", 2.0, 2, "UK"), ("6", "C", "Candle", -90000, "2011-01-05", 2.0, 2, "UK")]


def test_aliases_and_types(spark):
    df = spark.createDataFrame([(" 1 ", "a", "x", "1", "2011-01-01", "1.5", "12346.0", " UK "), ("2", "b", None, "bad", "never", "n", "", "UK")],
                               "Invoice string, StockCode string, Description string, Quantity string, InvoiceDate string, Price string, `Customer ID` string, Country string")
    rows = {r["invoice"]: r for r in invoices.standardise_columns(df).collect()}
    assert rows["1"]["stock_code"] == "A" and rows["1"]["customer_id"] == 12346 and rows["1"]["country"] == "UK"
    assert rows["1"]["invoice_date"] == day("2011-01-01")
    assert [rows["2"][c] for c in ("quantity", "invoice_date", "unit_price", "customer_id")] == [None] * 4
    other = invoices.standardise_columns(df.withColumnRenamed("Price", "UnitPrice").withColumnRenamed("Customer ID", "CustomerID"))
    assert {"unit_price", "customer_id"} <= set(other.columns)


def test_csv_with_quotes_and_gzip(spark, tmp_path):
    df = raw(spark, [("1", "A", 'say "hi", twice', 1, "2011-01-01", 1.5, 7, "UK")])
    df.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(str(tmp_path / "in"))
    back = invoices.standardise_columns(invoices.read_csv(spark, str(tmp_path / "in"))).collect()
    assert len(back) == 1 and back[0]["quantity"] == 1.0 and back[0]["customer_id"] == 7


def test_landed_files_are_in_date_order(spark, tmp_path):
    df = raw(spark, [(str(i), "A", "x", 1, f"2011-{1 + i % 12:02d}-01", 1.0, i, "UK") for i in range(200)])
    invoices.land(df, str(tmp_path / "land"))
    parts = (spark.read.parquet(str(tmp_path / "land")).withColumn("f", F.input_file_name()).groupBy("f")
             .agg(F.min("invoice_date").alias("a"), F.max("invoice_date").alias("b")).orderBy("a").collect())
    assert all(x["b"] <= y["a"] for x, y in zip(parts, parts[1:]))


def test_cleaning_rules(spark):
    out = C.clean_transactions(raw(spark, CASE + FILLER)).collect()
    assert len(out) == len(CASE) - 1 + len(FILLER)
    of = lambda sku: [r for r in out if r["stock_code"] == sku]
    assert sum(r["is_return"] for r in out) == 2
    assert all(r["is_admin_code"] for r in of("POST"))
    assert all(r["is_price_adjustment"] and not r["has_customer_id"] for r in of("B"))
    assert {r["description"] for r in of("A")} == {"MUG RED"} and {r["category"] for r in of("A")} == {"kitchen_dining"}
    assert all(r["is_entry_error"] and not r["use_for_customer_model"] for r in of("C"))


def test_duplicate_counts_count_nulls_as_equal(spark):
    rows = [("1", "A", None, 1, "2011-01-01", 1.0, None, None)] * 3 + [("2", "A", None, None, "2011-01-01", 1.0, None, None)] * 2
    got = C.duplicate_counts(raw(spark, rows)).first()
    assert (got["rows_in"], got["rows_complete"], got["exact_duplicates_removed"]) == (5, 3, 2)


def test_unreversed_bulk_stays(spark):
    rows = [(str(i), "A", "X", 1 + i % 9, "2011-01-01", 1.0, i, "UK") for i in range(200)] + [("b", "A", "X", 3000, "2011-01-01", 1.0, 500, "UK")]
    df = raw(spark, rows)
    out = C.flag_outliers(C.flag_rows(df), C.fitted_fences(df)).where("quantity = 3000").first()
    assert out["is_bulk_outlier"] and not out["is_entry_error"]


def test_reversal_needs_same_customer_sku_and_size(spark):
    rows = [(str(i), "A", "X", 1 + i % 9, "2011-01-01", 1.0, i, "UK") for i in range(100)]
    rows += [("p", "A", "X", 500, "2011-01-01", 1.0, 1, "UK"), ("Cp", "A", "X", -500, "2011-01-02", 1.0, 1, "UK"),
             ("q", "A", "X", 600, "2011-01-01", 1.0, 1, "UK"), ("Cq", "A", "X", -600, "2011-01-02", 1.0, 2, "UK"),
             ("g", "A", "X", 700, "2011-01-01", 1.0, None, "UK"), ("Cg", "A", "X", -700, "2011-01-02", 1.0, None, "UK")]
    df = raw(spark, rows)
    bad = C.flag_outliers(C.flag_rows(df), C.fitted_fences(df)).where("is_entry_error").select(F.abs("quantity").alias("q")).collect()
    assert [r["q"] for r in bad] == [500.0, 500.0]


def test_categories_and_text(spark):
    df = spark.createDataFrame([("RED CANDLE HOLDER",), ("PINK MUGS",), ("STRANGE THING",), (None,), ("CUPBOARD",), ("tea  lamp x",)], "t string")
    assert [r[0] for r in df.select(category_of(F.col("t"), DEFAULTS.category_words)).collect()] == \
        ["lighting", "kitchen_dining", "other", "other", "other", "lighting"]
    assert df.select(tidy_text(F.col("t"))).collect()[5][0] == "TEA LAMP X"


def test_description_vote_ties_go_to_the_alphabet(spark):
    df = raw(spark, [("1", "A", d, 1, "2011-01-01", 1.0, 1, "UK") for d in ("zinc", "ash", "zinc", "ash", None)] +
             [("1", "B", None, 1, "2011-01-01", 1.0, 1, "UK")])
    assert [(r[0], r[1]) for r in C.description_lookup(df).collect()] == [("A", "ASH")]
    assert {r[1] for r in C.description_lookup(df, {"ash": "zinc"}).collect()} == {"ZINC"}


def test_validation_fails_loudly(spark):
    good = raw(spark, [("1", "A", "X", 1, "2011-01-01", 1.0, 1, "UK")])
    assert V.validate_transactions(good)["rows"] == 1
    with pytest.raises(V.ValidationError, match="no column unit_price"):
        V.validate_transactions(good.drop("unit_price"))
    with pytest.raises(V.ValidationError, match="date_min is 1999"):
        V.validate_transactions(good.withColumn("invoice_date", F.lit("1999-01-01").cast("timestamp_ntz")))
    with pytest.raises(V.ValidationError, match="null_rate_customer_id is 1 "):
        V.validate_transactions(good.withColumn("customer_id", F.lit(None).cast("long")))
    with pytest.raises(V.ValidationError, match="rows is 0"):
        V.validate_transactions(good.limit(0))
    both = good.withColumn("invoice_date", F.lit("x")).withColumn("unit_price", F.lit(0.0))
    with pytest.raises(V.ValidationError, match="invoice_date is of kind date.*nonpositive_price_rate is 1"):
        V.validate_transactions(both.withColumn("invoice_date", F.lit("2011-01-01").cast("date")),
                                DEFAULTS.with_(expected_date_min=day("2000-01-01").date(), expected_date_max=day("2020-01-01").date()))


def test_record_rules(spark):
    good = dict(customer_id=1, country="UK", recency_days=5.0, frequency=2.0, total_spend=10.0, avg_spend=5.0, historical_clv=9.0,
                avg_basket_size=3.0, freq_trend=None, gap_variance=None, seasonal_concentration=0.5, return_rate=0.0,
                discount_sensitivity=0.0, avg_product_popularity=0.1, affinity_lighting=0.4, affinity_toys_games=0.6)
    schema = ", ".join(f"{k} {'long' if k == 'customer_id' else 'string' if k == 'country' else 'double'}" for k in good)
    bad = [dict(good, customer_id=i + 2, **c) for i, c in enumerate([
        {"recency_days": -1.0}, {"frequency": 0.0}, {"seasonal_concentration": 0.0}, {"return_rate": 1.5}, {"country": ""},
        {"country": "x" * 65}, {"avg_spend": None}, {"affinity_lighting": 0.5}, {"affinity_lighting": -0.1}])]
    df = spark.createDataFrame([tuple(r.values()) for r in [good, *bad]], schema)
    valid, rejects = V.split_records(df)
    assert [r["customer_id"] for r in valid.collect()] == [1] and valid.first()["freq_trend"] == 0.0
    assert {r["customer_id"]: len(r["errors"]) for r in rejects.collect()} == {i: 1 for i in range(2, 11)}
    assert V.batch_report(df).first().asDict() == {"n_rows": 10, "n_scored": 1, "n_failed": 9}
    assert V.missing_record_columns(df.drop("country", "frequency")) == ["country", "frequency"]


def test_rows_of_files_have_their_line_numbers(spark, tmp_path):
    """Files read in many blocks: each row gets the number of its line, header counted."""
    want = set()
    for f in range(3):
        lines = [f"{f}-{i},{'x' * (i % 37)}" for i in range(400 + 50 * f)]
        (tmp_path / f"part{f}.csv").write_text("a,b\n" + "\n".join(lines) + "\n")
        want |= {(f"part{f}.csv", i + 2, line.split(",")[0]) for i, line in enumerate(lines)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = I.with_file_rows(spark.read.option("header", True).csv(str(tmp_path)))
        assert got.select("file_name", "file_row", "a").count() == len(want)
        assert {tuple(r) for r in got.select("file_name", "file_row", "a").collect()} == want
        assert spark.read.option("header", True).csv(str(tmp_path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_of_an_order_stay_side_by_side(spark):
    rows = [(f"{i // 5}", f"P{i % 7}", "x", float(i % 5), "2011-01-01", 1.0, i // 50, "UK") for i in range(500)]
    rows += [(None, f"P{i}", "x", 1.0, "2011-01-01", 1.0, None, "UK") for i in range(3)] * 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = C.drop_exact_duplicates(raw(spark, rows + rows[:40])).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(set(rows))
    spots = {}
    for r in found:
        spots.setdefault((r["invoice"], r["customer_id"]), set()).add(r["_task"])
    assert len(set().union(*spots.values())) > 1 and all(len(v) == 1 for v in spots.values())
