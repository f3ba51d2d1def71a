import pytest
from pyspark.sql import functions as F

from holdfast.operators import customers
from holdfast.operators.filters import CustomerFilter, check_export
from tests.helpers import one, prediction, predictions, recommendations, segments


@pytest.fixture(scope="module")
def data(spark):
    rows = [prediction(f"C{i:05d}", i / 100, "Low" if i < 35 else "Medium") for i in range(60)]
    rows += [prediction("C90000", None, None, None, None, None), prediction("C90001", 0.59)]
    names = [f"C{i:05d}" for i in range(0, 60, 2)] + ["C90000"]
    return (
        predictions(spark, rows),
        segments(spark, [(n, 1, "Service Issue Segment") for n in names]),
        recommendations(spark, [(n, "Tariff Optimization", "because", "High") for n in names if n != "C00002"]),
    )


def ids(df):
    return [r["customer_id"] for r in df.collect()]


def test_null_probability_comes_first_and_shows_as_zero(data):
    found = customers.customer_list(*data, limit=3).collect()
    assert [r["customer_id"] for r in found] == ["C90000", "C00059", "C90001"]
    assert found[0]["churn_probability"] == 0 and found[0]["health_score"] == 100
    assert found[0]["scoring_date"] is None
    assert {r["total_count"] for r in found} == {62}
    assert found[1]["segment_name"] is None


def test_pages_join_up(data):
    whole = ids(customers.customer_list(*data, limit=500))
    pieces = [ids(customers.customer_list(*data, limit=25, offset=o)) for o in (0, 25, 50)]
    assert sum(pieces, []) == whole and len(whole) == 62


def test_page_beyond_the_end_has_no_rows(data):
    beyond = customers.customer_list(*data, limit=10, offset=62)
    assert customers.page_payload(beyond, 10, 62) == {"items": [], "total": 0, "limit": 10, "offset": 62}
    last = customers.page_payload(customers.customer_list(*data, limit=10, offset=61), 10, 61)
    assert (len(last["items"]), last["total"]) == (1, 62)
    assert last["items"][0]["health_status"]["code"] == "healthy"


@pytest.mark.parametrize("offset", [0, 30, 55, 60, 70])
def test_pages_do_not_depend_on_how_far_the_order_is_narrowed(data, monkeypatch, offset):
    expected = customers.customer_list(*data, limit=5, offset=offset).collect()
    drilled = customers.segment_customers(*data, "Service Issue Segment", 5, offset).collect()
    monkeypatch.setattr(customers, "SPLITTERS", 3)
    scope, before = customers.page_scope(data[0], 5, offset, scope=8)
    assert offset >= 62 or (before <= offset and scope.count() < 62 or offset == 0)
    page = scope.orderBy(*customers._order()).offset(offset - before).limit(5)
    assert ids(page) == [r["customer_id"] for r in expected]
    assert customers.segment_customers(*data, "Service Issue Segment", 5, offset).collect() == drilled


def test_repeated_ids_do_not_lengthen_a_page(data):
    twice = data[0].union(data[0])
    assert customers.top_rows(twice, 1, 30).count() == 1
    scope, before = customers.page_scope(twice, 1, 61, scope=2)
    assert ids(scope.orderBy(*customers._order()).offset(61 - before).limit(1)) == ids(customers.top_rows(twice, 1, 61))


def test_look_up_refuses_more_rows_than_a_page_has(data, spark):
    rows = spark.range(501).selectExpr("CAST(id AS STRING) AS customer_id")
    with pytest.raises(ValueError, match="500 rows"):
        customers.look_up(rows, data[1])


@pytest.mark.parametrize(
    "text, wanted",
    [("a\\b", {"ab", "xaby"}), ("b\\", {"b%"}), ("\\%", {"b%"}), ("a\\_", {"a_b"}), ("a\\\\b", {"a\\b"}), ("A_B", {"a_b", "a\\b"})],
)
def test_backslashes_in_a_search(spark, text, wanted):
    rows = spark.createDataFrame([(i,) for i in ("ab", "xaby", "b%", "a_b", "a\\b")], "customer_id string")
    assert set(ids(CustomerFilter(search=text).apply(rows))) == wanted


@pytest.mark.parametrize("limit, offset", [(0, 0), (501, 0), (10, -1)])
def test_page_limits(data, limit, offset):
    with pytest.raises(ValueError):
        customers.customer_list(*data, limit=limit, offset=offset)


@pytest.mark.parametrize(
    "chosen, expected",
    [
        (CustomerFilter(), 62),
        (CustomerFilter(risk_group="All", segment="", main_risk_factor="All"), 62),
        (CustomerFilter(risk_group="Low"), 35),
        (CustomerFilter(segment="Service Issue Segment"), 31),
        (CustomerFilter(recommendation="Tariff Optimization"), 30),
        (CustomerFilter(min_probability=0.0), 61),
        (CustomerFilter(min_probability=0.5), 11),
        (CustomerFilter(search="c9"), 2),
        (CustomerFilter(search="c_000%"), 12),
        (CustomerFilter(main_risk_factor="High day charge", risk_group="Low", segment="Service Issue Segment"), 18),
    ],
)
def test_filters(data, chosen, expected):
    rows = customers.result_rows(*data)
    assert chosen.apply(rows).count() == expected
    page = customers.customer_list(*data, chosen, limit=500).collect()
    assert len(page) == expected and {r["total_count"] for r in page} <= {expected}


def test_detail(data):
    found = one(customers.customer_detail(*data, "C00058"))
    assert found["prediction"]["scoring_date"] == "2024-05-06 07:08:09"
    assert found["segment"]["segment_name"] == "Service Issue Segment"
    assert found["health"]["expected_effect"]["processing_priority"] == 1
    assert found["health"]["next_best_action"]["recommendation_reason"] == "because"
    plain = one(customers.customer_detail(*data, "C00001"))
    assert plain["health"]["next_best_action"]["recommendation_type"] == "No Action"
    assert plain["recommendation"]["priority"] is None
    assert customers.customer_detail(*data, "nobody").isEmpty()


def test_drill_downs(data):
    members = customers.segment_customers(*data, "Service Issue Segment", limit=2, offset=1)
    assert ids(members) == ["C00058", "C00056"]
    advised = customers.recommendation_customers(*data, "Tariff Optimization", limit=500)
    assert advised.count() == 30 and "segment_id" not in advised.columns
    assert customers.segment_customers(*data, "nothing").isEmpty()


def test_page_bounds(spark):
    rows = spark.range(101)
    assert one(customers.page_bounds(rows, 3, 50)).asDict() == {
        "total": 101, "pages": 3, "first_row": 101, "last_row": 101
    }
    assert one(customers.page_bounds(rows.where("id < 0"), 1, 50)).asDict() == {
        "total": 0, "pages": 1, "first_row": 0, "last_row": 0
    }


def test_filter_options(data):
    found = {k: [r[0] for r in v.collect()] for k, v in customers.filter_options(*data).items()}
    assert found["risk_groups"] == ["Medium", "Low"]
    assert found["segments"] == ["Service Issue Segment"]
    assert found["main_risk_factors"] == ["High day charge"]


@pytest.mark.parametrize(
    "chosen", [CustomerFilter(), CustomerFilter(search="  "), CustomerFilter(min_probability=0.0),
               CustomerFilter(risk_group="All")]
)
def test_export_needs_a_filter(chosen):
    with pytest.raises(ValueError, match="filter is required"):
        check_export(chosen, None)


@pytest.mark.parametrize("value", [-0.1, 1.1])
def test_probability_bounds(value):
    with pytest.raises(ValueError, match="min_probability"):
        CustomerFilter(min_probability=value)


def test_export_refuses_unknown_fields():
    with pytest.raises(ValueError, match="Unknown"):
        check_export(CustomerFilter(search="x"), ["priority", "password"])
    check_export(CustomerFilter(min_probability=0.1), ["priority"])


def test_unused_tables_are_not_counted(data):
    """A filter on a missing segment drops the customer, as an SQL comparison does."""
    rows = customers.result_rows(*data)
    assert CustomerFilter(segment="Other").apply(rows).isEmpty()
    assert rows.where(F.col("segment_name").isNull()).count() == 31
