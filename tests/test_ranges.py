import random
from datetime import datetime

import pytest

from inkgauge.operators import delivery

SCHEMA = "delivery_id bigint, item_id string, raw_value string, received_at timestamp"
NUMBERS = "producer string, number bigint"


def rows_of(r, n=500):
    rows = []
    for i in range(n):
        name = r.choice([f"m-{r.randrange(60):09}", f"k{delivery.BLOCK - 5 + r.randrange(10):09}", "free", "m-7", None, ""])
        raw = r.choice(['{"x":1}', '{ "x": 1 }', '{"x":2}', "no json", None, '{"id":"m-000000007"}'])
        rows.append((i, name, raw, r.choice([None, *[datetime(2026, 1, 1, h) for h in range(24)]])))
    return rows


def by_hand(rows):
    kept, order = {}, lambda row: (row[3] is None, row[3] or datetime.min, row[0])
    for row in sorted(rows, key=order):
        identifier, digest = delivery._message(row[1], row[2])
        if identifier:
            kept.setdefault((identifier, digest), row[0])
    named = {row[0] for row in rows if delivery._message(row[1], row[2])[0]}
    return sorted(named - set(kept.values()))


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_agree_with_a_dictionary(spark, batches):
    rows = rows_of(random.Random(5))
    got = sorted(r[0] for r in delivery.surplus(spark.createDataFrame(rows, SCHEMA), batches).collect())
    assert got and got == by_hand(rows)


def test_empty_and_undated_tables(spark):
    assert delivery.surplus(spark.createDataFrame([], SCHEMA)).count() == 0
    undated = spark.createDataFrame([(2, "m-000000001", "1", None), (1, "m-000000001", "1", None), (3, "m-000000002", "1", None)], SCHEMA)
    assert [r[0] for r in delivery.surplus(undated).collect()] == [2]


def test_numbers_are_placed_in_ranges(spark):
    b = delivery.BLOCK
    seen = spark.createDataFrame([("p", 0, 2, 4), ("p", 0, 7, 7), ("p", 1, b, 2 * b - 1), ("q", 0, 0, 9)], "producer string, block bigint, low bigint, high bigint")
    asked = spark.createDataFrame([("p", n) for n in (1, 2, 4, 5, 7, 8, b - 1, b, 2 * b - 1, 2 * b)] + [("q", 9), ("r", 3)], NUMBERS)
    old = {(r.producer, r.number) for r in delivery.placed(asked, seen).filter("old").collect()}
    assert old == {("p", 2), ("p", 4), ("p", 7), ("p", b), ("p", 2 * b - 1), ("q", 9)}


def test_ranges_are_disjoint_and_maximal(spark):
    b = delivery.BLOCK
    r = random.Random(3)
    numbers = [("p", r.randrange(b - 40, b + 40)) for _ in range(90)] + [("q", 5), ("q", 5), ("q", 6), (None, 4)]
    half = [spark.createDataFrame(numbers[k::2], NUMBERS) for k in (0, 1)]
    seen = delivery.islands(half[0])
    fresh = delivery.placed(half[1].filter("producer is not null").distinct(), seen).filter("not old")
    seen = delivery.merged(seen.unionByName(delivery.islands(fresh)))
    wanted, last = [], None
    for p, n in sorted({x for x in numbers if x[0]}):
        if last and last[0] == p and last[2] + 1 == n:
            last[2] = n
        else:
            wanted.append(last := [p, n, n])
    assert sorted(list(x) for x in delivery.ranges(seen).collect()) == wanted
    assert all(x.low // b == x.high // b == x.block for x in seen.collect())


def test_the_state_grows_with_ranges_and_not_with_messages(spark):
    rows = [(i, f"m-{i:09}", '{"x":1}', datetime(2026, 1, 1, i % 24)) for i in range(3000)]
    known = delivery.messages(spark.createDataFrame(rows, SCHEMA))
    accepted, state = delivery.absorbed(known, 2)
    assert accepted.count() == accepted.filter("by_range").count() == 3000
    assert [(r.low, r.high) for r in state.seen.collect()] == [(0, 2999)] and state.keys.count() == 0


def test_covered_numbers_and_malformed_identifiers_are_looked_up(spark):
    def batch(rows):
        return delivery.messages(spark.createDataFrame(rows, SCHEMA))

    at = datetime(2026, 1, 1)
    first = [(1, "m-000000001", '{"x":1}', at), (2, "free", '{"x":1}', at), (8, "m-000000009", '{"x":1}', at), (9, "m-000000009", '{"x":2}', at)]
    new, state = delivery.absorb(batch(first), delivery.empty_state(spark))
    assert sorted((r.delivery_id, r.identifier, r.by_range) for r in new.collect()) == [
        (1, "m-000000001", True), (2, "free", False), (8, "m-000000009", False), (9, "m-000000009", False)
    ]
    second = [(3, "m-000000001", '{"x":1}', at), (4, "m-000000001", '{"x":2}', at), (5, "m-000000002", '{"x":1}', at), (6, "free", '{"x":1}', at), (7, None, None, None), (10, "m-000000009", '{"x":2}', at)]
    new, state = delivery.absorb(batch(second), state)
    assert sorted((r.delivery_id, r.by_range) for r in new.collect()) == [(4, False), (5, True)]
    assert sorted((r.low, r.high) for r in state.seen.collect()) == [(1, 2), (9, 9)] and state.keys.count() == 1
