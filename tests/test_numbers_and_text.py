import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.functions import labels as L
from holdfast.functions import screen, text
from holdfast.functions.health import health_score, health_status, processing_priority, risk_drivers
from holdfast.functions.numbers import clamp, exact_round, half_up_round, whole_round
from tests.helpers import DATE, evaluate, one


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def check_rounding(spark, values):
    rows = doubles(spark, values).select(
        "x", *[exact_round(F.col("x"), d).alias(f"r{d}") for d in (1, 2, 4)],
        whole_round(F.col("x")).alias("w"), text.decimal_text(F.col("x")).alias("t"),
    ).collect()
    for row in rows:
        for digits in (1, 2, 4):
            assert row[f"r{digits}"] == round(row["x"], digits), (row["x"], digits)
        assert row["w"] == round(row["x"])
        assert row["t"] == f"{row['x']:.2f}".replace(".", ",")


def test_rounding_is_exact_on_ties_and_near_ties(spark):
    source = random.Random(1)
    values = [2.675, 0.125, 0.375, 1.005, 20.995, 0.0, 82.5, 83.5, 1e-9, 99999.995]
    values += [source.randint(0, 40000) / 10 * rate for rate in (0.17, 0.085, 0.045, 0.27) for _ in range(1500)]
    values += [source.randint(0, 10**6) / 1000 + 0.0005 * source.randint(0, 1) for _ in range(1500)]
    check_rounding(spark, values)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1e6), min_size=1, max_size=200))
def test_rounding_of_any_double(spark, values):
    check_rounding(spark, [v + 0.0 for v in values])


def test_rounding_of_null_and_negative(spark):
    rows = doubles(spark, [None, -2.675, -0.5]).select(exact_round(F.col("x"), 2).alias("r")).collect()
    assert [r["r"] for r in rows] == [None, -2.67, -0.5]


def test_half_up_and_clamp(spark):
    assert evaluate(spark, half_up_round(F.lit(2.5))) == 3
    assert evaluate(spark, clamp(F.lit(7.0), 0.0, 5.0)) == 5.0
    assert evaluate(spark, clamp(F.lit(-7.0), 0.0, 5.0)) == 0.0


def score(spark, probability, group, factor, charge):
    return evaluate(
        spark,
        health_score(F.lit(probability), F.lit(group), F.lit(factor).cast("string"), F.lit(charge)),
    )


def test_health_scores(spark):
    assert score(spark, 0.2, "Low", None, 40.0) == score(spark, 0.2, "Low", L.STABLE_FACTOR, 40.0) == 86
    assert score(spark, 1.0, "High", "High day charge", 80.0) == 15
    assert score(spark, 0.25, "Low", None, 40.0) == 82


@pytest.mark.parametrize(
    "value, code", [(15, "critical"), (35, "critical"), (36, "needs_attention"), (60, "needs_attention"),
                    (61, "stable"), (80, "stable"), (81, "healthy"), (86, "healthy")]
)
def test_health_status(spark, value, code):
    assert evaluate(spark, health_status(F.lit(value)))["code"] == code


def test_only_four_drivers_stay(spark):
    found = evaluate(
        spark,
        risk_drivers(F.lit(0.9), F.lit("High day charge"), F.lit(85.0), F.lit("S"), F.lit("A")),
    )
    assert [d["code"] for d in found] == [
        "main_risk_factor", "high_churn_probability", "high_estimated_charge", "segment",
    ]
    assert found[1]["value_num"] == 0.9 and found[1]["value_text"] is None
    none = F.lit(None).cast("string")
    assert evaluate(spark, risk_drivers(F.lit(0.1), none, F.lit(1.0), none, F.lit(L.NO_ACTION))) == []


@pytest.mark.parametrize(
    "group, label, expected",
    [("Low", "High", 1), ("Low", "Средний", 2), ("High", "Низкий", 3), ("High", None, 1),
     ("Medium", "?", 2), (None, None, 3)],
)
def test_processing_priority(spark, group, label, expected):
    found = processing_priority(F.lit(group).cast("string"), F.lit(label).cast("string"))
    assert evaluate(spark, found) == expected


def test_text_of_null(spark):
    nothing = F.lit(None).cast("double")
    assert evaluate(spark, text.decimal_text(nothing)) == ""
    assert evaluate(spark, text.percent_text(nothing)) == ""
    assert evaluate(spark, text.percent_text(F.lit(0.125))) == "12%"
    assert evaluate(spark, text.decimal_text(F.lit(0.33335), 4)) == f"{0.33335:.4f}".replace(".", ",")


def test_dates(spark):
    moment = F.lit(DATE)
    assert evaluate(spark, text.timestamp_text(moment)) == str(DATE)
    fine = DATE.replace(microsecond=120)
    assert evaluate(spark, text.timestamp_text(F.lit(fine))) == str(fine)
    assert evaluate(spark, text.day_text(moment)) == "06.05.2024"
    assert evaluate(spark, text.day_text(F.lit("2024-05-06T07:08:09"), is_text=True)) == "06.05.2024"
    assert evaluate(spark, text.day_text(F.lit("soon"), is_text=True)) == "soon"
    assert evaluate(spark, text.day_text(F.lit(None).cast("timestamp"))) == ""
    assert evaluate(spark, text.minute_text(F.lit("2024-05-06 07:08:09.5"))) == "2024-05-06 07:08"
    assert evaluate(spark, text.minute_text(F.lit("bad.text"))) == "bad"
    assert evaluate(spark, text.minute_text(F.lit(""))) == "-"


def test_labels(spark):
    assert evaluate(spark, text.translated(F.lit("High"), L.RISK_GROUP_TEXT)) == "Высокий риск"
    assert evaluate(spark, text.translated(F.lit("Other"), L.RISK_GROUP_TEXT)) == "Other"
    assert evaluate(spark, text.translated(F.lit(None).cast("string"), L.RISK_GROUP_TEXT)) is None
    assert evaluate(spark, text.screen_text(F.lit(""), L.FACTOR_TEXT)) == "-"
    assert evaluate(spark, text.screen_group_text(F.lit(""), L.RISK_GROUP_TEXT)) == ""
    assert evaluate(spark, text.screen_group_text(F.lit(None).cast("string"), L.RISK_GROUP_TEXT)) == "-"
    assert evaluate(spark, text.short_action_text(F.lit("Voice Mail Offer"))) == "Голосовая почта"
    assert evaluate(spark, text.short_action_text(F.lit("No Action"))) == "Без действия"
    # exports do not know the current segment names, screens do
    assert evaluate(spark, text.translated(F.lit(L.STABLE_SEGMENT), L.SEGMENT_TEXT)) == L.STABLE_SEGMENT
    assert evaluate(spark, text.screen_text(F.lit(L.STABLE_SEGMENT), L.SCREEN_SEGMENT_TEXT)) == "Стабильные клиенты"


@pytest.mark.parametrize(
    "value, start",
    [
        (L.REASONS[L.SERVICE_CALL], "У клиента много обращений"),
        ("Too many SERVICE CALLS lately", "У клиента много обращений"),
        ("total day charge is up", "У клиента высокое дневное потребление или"),
        ("has no voice mail", "У клиента не подключена голосовая почта; предложите услугу как дополнительное"),
        ("stable account", "У клиента низкая вероятность оттока; явный"),
        ("High total charge", "У клиента высокая оценочная сумма"),
        ("anything else", "anything else"),
        ("", "-"),
        (None, "-"),
    ],
)
def test_reason_text(spark, value, start):
    assert evaluate(spark, text.reason_text(F.lit(value).cast("string"))).startswith(start)


def test_screen_expressions(spark):
    row = one(
        spark.range(1).select(
            screen.attention_level(F.lit(0.2), F.lit(0.1), F.lit(10))["tone"].alias("by_count"),
            screen.attention_level(F.lit(0.2), F.lit(0.1), F.lit(2))["tone"].alias("calm"),
            screen.direction_from(F.lit(0.504), F.lit(0.5)).alias("level"),
            screen.direction_from(F.lit(0.4), F.lit(0.5)).alias("below"),
            screen.points_from(F.lit(0.625), F.lit(0.5)).alias("points"),
            screen.share_tone(F.lit(0.15)).alias("share"),
            screen.probability_tone(F.lit(0.7)).alias("probability"),
        )
    )
    assert row.asDict() == {
        "by_count": "red", "calm": "green", "level": "level", "below": "below", "points": 13,
        "share": "amber", "probability": "red",
    }
