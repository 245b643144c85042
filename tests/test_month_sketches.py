"""Month sketches against the exact figures: bounds of the error, and which months are read."""
from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.config import DEFAULTS
from patronage.functions.expressions import hash_unit
from patronage.operators import clean as C
from patronage.operators import month_sketches as S
from patronage.operators import validate as V
from patronage.sources import sinks


@pytest.fixture(scope="module")
def lines(spark):
    u = lambda s: hash_unit(F.col("id"), s)
    df = spark.range(60_000).select(
        F.timestamp_add("DAY", (u("d") * 300).cast("int"), F.lit("2010-01-05 10:00:00").cast("timestamp_ntz")).alias("invoice_date"),
        F.floor(F.exp(3 * u("q")) * F.when(u("r") < 0.05, -1).otherwise(1)).cast("long").alias("quantity"),
        F.when(u("z") < 0.02, 0.0).otherwise(F.exp(2 * u("p"))).alias("unit_price"),
        F.when(u("n") > 0.2, (u("c") * 9000).cast("long")).alias("customer_id"),
        F.when(u("m") > 0.01, "x").alias("description"), F.lit("1").alias("invoice"), F.lit("A").alias("stock_code"), (u("r") < 0.05).alias("is_return"))
    return df.persist()


def test_fences_and_profile_of_merged_months(lines):
    months = S.sketched(lines).persist()
    assert months.count() == 10
    got, exact = S.fences(months, 3.0).first(), C.tukey_fences(lines, 3.0).first()
    priced = np.array(lines.where("unit_price > 0").select(F.abs("quantity"), "unit_price").collect(), dtype=float)
    for i, m in enumerate(("q", "p")):
        values = np.sort(priced[:, i])
        spread = (got[f"{m}_hi"] - got[f"{m}_lo"]) / 7  # fences lie three spreads beyond the quartiles
        for share, quartile in ((0.25, got[f"{m}_lo"] + 3 * spread), (0.75, got[f"{m}_hi"] - 3 * spread)):
            low, high = np.searchsorted(values, quartile - 1e-9) / len(values), np.searchsorted(values, quartile + 1e-9, "right") / len(values)
            assert low - S.RANK_ERROR <= share <= high + S.RANK_ERROR
        assert got[f"{m}_hi"] == pytest.approx(exact[f"{m}_hi"], rel=0.05)
    found, want = S.profile(months).first().asDict(), V.transaction_profile(lines).first().asDict()
    assert all(found[k] == pytest.approx(v, rel=1e-12) if isinstance(v, float) else found[k] == v for k, v in want.items())
    assert found["n_is_return"] == lines.where("is_return").count() and found["n_is_admin_code"] is None
    customers = lines.agg(F.count_distinct("customer_id")).first()[0]
    assert abs(found["unique_customers"] / customers - 1) < 3 * S.DISTINCT_ERROR


def test_only_new_months_are_read(spark, lines, tmp_path):
    table, path = str(tmp_path / "clean"), str(tmp_path / "sketches")
    early = lines.where("invoice_date < TIMESTAMP_NTZ '2010-04-01'")
    sinks.write_clean(early, table)
    first = S.refresh(spark.read.parquet(table), path)
    assert first == ["2010-01-01", "2010-02-01", "2010-03-01"]
    sinks.write_clean(lines.where("invoice_date < TIMESTAMP_NTZ '2010-06-01'"), table)
    assert S.refresh(spark.read.parquet(table), path) == ["2010-03-01", "2010-04-01", "2010-05-01"]
    whole = lines.where("invoice_date < TIMESTAMP_NTZ '2010-06-01'")
    kept = S.profile(S.read(spark, path)).first().asDict()
    assert kept == S.profile(S.sketched(whole)).first().asDict() or kept["rows"] == whole.count()
    plan = spark.read.parquet(table).where("invoice_month = DATE '2010-04-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(invoice_month" in plan


def test_no_lines_and_no_prices(spark, lines):
    none = S.sketched(lines.limit(0))
    assert none.count() == 0 and S.profile(none).first()["rows"] is None
    free = S.sketched(lines.where("unit_price = 0"))
    row = S.fences(free, 3.0).first()
    assert row["q_hi"] is None and S.profile(free).first()["nonpositive_price_rate"] == 1.0
