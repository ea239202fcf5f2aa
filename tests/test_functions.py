from pyspark.sql import functions as F

from fieldtally.constants import AGE_BANDS_DAYS, FEATURES, MALARIA_SCHEDULE_MONTHS, VITAMIN_A_SCHEDULE_MONTHS
from fieldtally.functions import dates as D
from fieldtally.functions import numbers as N
from fieldtally.functions import risk as R
from fieldtally.functions import schedule as S
from fieldtally.functions import text as X


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_booleans_and_flags(spark):
    assert values(spark, X.loose_boolean, ["yes", "no", "true", "0", None, " Y ", "1.0", "maybe"]) == [1, 0, 1, 0, None, 1, 1, None]
    assert values(spark, X.yes_no, [" Yes", "no", "true", None]) == [1, 0, None, None]
    assert values(spark, X.mixed_flag, ["TRUE", "No", "1", "x", None]) == [1, 0, 1, None, None]
    assert values(spark, X.sex_text, ["M", " f", "male", None]) == ["male", "female", "male", None]


def test_known_names(spark):
    assert values(spark, X.known_name, [" Nairobi ", "Atlantis", None]) == ["nairobi", None, None]
    assert values(spark, X.known_name_flag, [" Nairobi ", "Atlantis", None]) == [1, 0, 0]


def test_month_token(spark):
    got = values(spark, D.month_token, ["Feb25_2", "Dec24", "mar25", "Xyz25", " 2025-01 ", None])
    assert got == ["2025-02", "2024-12", "2025-03", "2025-00", "2025-01", None]


def test_json_map(spark):
    assert values(spark, X.json_map, [None, "bad", '{"k":"v"}', '{"k":', "[1]"]) == [{}, {}, {"k": "v"}, {}, {}]


def test_numbers(spark):
    inf = float("inf")
    assert values(spark, N.non_negative, ["1", "-1", "0", "x", None]) == [1.0, None, 0.0, None, None]
    assert values(spark, N.finite_unit, [inf, -inf, 2.0, -1.0, 0.5, None, float("nan")], "double") == [None, None, 1.0, 0.0, 0.5, None, None]
    assert values(spark, lambda c: N.guarded_ratio(F.lit(3.0), c), [0.0, -1.0, 2.0, 6.0, None], "double") == [None, None, 1.0, 0.5, None]
    assert values(spark, N.positive_flag, [0.0, 1.0, None], "double") == [0, 1, 0]


def test_bands_are_right_closed(spark):
    got = values(spark, lambda c: N.bands(c, *AGE_BANDS_DAYS), [-1.0, 0.0, 41.0, 42.0, 1825.0, 1826.0, None], "double")
    assert got == [None, "0-6w", "0-6w", "6-10w", "24m+", None, None]


def test_expected_doses(spark):
    assert values(spark, S.expected_doses, [0.0, 2.0, 9.0, 18.0, None], "double") == [2, 6, 16, 17, 0]
    with_region = lambda c: S.expected_doses_with_region(c, F.lit(True))
    assert values(spark, with_region, [8.0, 30.0], "double") == [18, 21]
    assert values(spark, lambda c: S.expected_doses(c, VITAMIN_A_SCHEDULE_MONTHS), [5.0, 6.0, 12.0, 60.0], "double") == [0, 1, 2, 10]
    assert len(MALARIA_SCHEDULE_MONTHS) == 4 and len(FEATURES) == 50


def test_expected_names(spark):
    names = values(spark, S.expected_names, [100.0, 0.0, None], "double")
    assert "has_penta_3" in names[0] and "has_measles_9_months" not in names[0]
    assert names[1] == ["has_bcg", "has_opv_0"] and names[2] == []


def test_due_list_with_absent_flag(spark):
    df = spark.createDataFrame([(45.0, 1, None)], "age_days double, has_bcg int, has_opv_0 int")
    row = S.schedule_labels(df).first()
    assert row["due_vaccines_rebuilt"] == "has_opv_0;has_opv_1;has_penta_1;has_pcv_1;has_rota_1"
    assert (row["num_received_vaccines"], row["num_due_vaccines_rebuilt"], row["default_30d"]) == (1, 5, 1)


def test_tiers(spark):
    assert values(spark, R.score_tier, [0.1, 0.33, 0.45, 0.6, 0.8, 1.0, None], "double") == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH", None]
    assert values(spark, R.list_tier, [0.0, 0.5, 0.51, 0.75, 0.76, 1.0], "double") == ["medium", "medium", "high", "high", "critical", "critical"]


def test_months_since_floors_elapsed_days(spark):
    as_of = F.to_timestamp(F.lit("2025-01-31 00:00:00"))
    got = values(spark, lambda c: D.months_since(c.cast("timestamp"), as_of), ["2025-01-29 12:00:00", "2030-01-01", "2000-01-01", None])
    assert abs(got[0] - 1 / 30.44) < 1e-12 and got[1:] == [0.0, 24.0, None]


def test_texts(spark):
    df = spark.createDataFrame([("measles_booster_gap", 1.0, 0.2), ("measles_booster_gap", 0.0, 0.2), ("has_penta_1", 1.0, -0.1)], "f string, v double, s double")
    got = [r[0] for r in df.select(R.plain_english(F.col("f"), F.col("v"), F.col("s"))).collect()]
    assert got[0].endswith("this increases defaulter risk") and got[1] == "Measles booster gap not detected"
    assert got[2] == "Penta-1 received value=1.00 reduces defaulter risk"
    action = df.select(R.recommended_action(F.lit("HIGH"), F.col("f"))).first()[0]
    assert action.endswith("schedule MR2 booster referral.")


def test_month_token_matches_once(spark):
    """One match a row, and none inside the text: only its beginning counts."""
    got = values(spark, D.month_token, [" feb25", "a Feb25", "Feb2", "FEB25x", "Feb٢٥", "", "9Feb25"])
    assert got == ["2025-02", "a Feb25", "Feb2", "2025-02", "Feb٢٥", "", "9Feb25"]
    plan = spark.createDataFrame([("a",)], "x string").select(D.month_token(F.col("x")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("regexp_extract") + plan.lower().count("rlike") == 1
