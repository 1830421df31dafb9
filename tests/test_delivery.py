import json
from datetime import datetime

from inkgauge.operators import delivery

SCHEMA = "delivery_id bigint, item_id string, raw_value string, received_at timestamp, keep string, n int"


def at(minute):
    return datetime(2026, 1, 1, 0, minute)


def surplus(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)
    return sorted(r[0] for r in delivery.surplus(df).collect())


def test_the_earliest_copy_is_kept(spark):
    a, b = '{"id":"m-000000001","x":1}', '{ "x": 1, "id": "m-000000001" }'
    rows = [(1, "m-000000001", a, None), (2, " m-000000001 ", b, at(2)), (3, "m-000000001", a, at(1)), (4, "m-000000001", a, at(1))]
    assert surplus(spark, rows) == [1, 2, 4]


def test_other_content_is_another_message(spark):
    rows = [(1, "m-000000001", '{"x":1}', at(1)), (2, "m-000000001", '{"x":2}', at(0)), (3, "m-000000001", '{"x":1}', at(2)), (4, "m-00000001", '{"x":1}', at(3))]
    assert surplus(spark, rows) == [3]


def test_identifiers_are_found_and_normalized(spark):
    composed, apart = "été", "été"
    rows = [(1, composed, '{"x":1}', at(1)), (2, apart, '{"x":1}', at(2)), (3, "", json.dumps({"id": "k"}), at(1)), (4, None, '{"id":"k"}', at(2)),
            (5, None, '{"y":1}', at(1)), (6, None, '{"y":1}', at(2)), (7, None, None, at(1)), (8, None, None, None)]
    assert surplus(spark, rows) == [2, 4]


def test_text_that_is_no_json_and_nulls(spark):
    rows = [(1, "a", "no json", at(1)), (2, "a", "no json", at(0)), (3, "a", None, at(1)), (4, "a", None, at(2)), (5, "a", "x" * 200_000, at(1)), (6, "a", "x" * 200_000, None)]
    assert surplus(spark, rows) == [1, 4, 6]


def test_empty_table(spark):
    assert surplus(spark, []) == []


def test_hot_message(spark):
    rows = [(i, "hot-000000001", '{"x":1}', at(i % 50)) for i in range(100)] + [(100 + i, f"s-{i // 2:09}", '{"x":1}', at(i % 2)) for i in range(40)]
    found = surplus(spark, rows)
    assert len(found) == 99 + 20 and 0 not in found
