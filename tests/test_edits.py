"""Edits over overlapping ranges and emended cells."""

import random

from witloom.operators import edits


def test_overlapping_ranges(spark):
    columns = spark.createDataFrame([("p", n, None if n else 9, n == 2, False, f"x{n}") for n in range(5)], "passage_id string, n int, group_id int, insignificant boolean, binary boolean, note string")
    ranges = spark.createDataFrame([("p", 0, 2, 1), ("p", 2, 3, 2), ("q", 0, 9, 3)], "passage_id string, low int, high int, group_id int")
    got = sorted(tuple(r) for r in edits.set_groups(columns, ranges).collect())
    assert [r[:3] for r in got] == [("p", 0, 1), ("p", 1, 1), ("p", 2, 2), ("p", 3, 2), ("p", 4, None)]
    assert [r[3:] for r in got] == [(n == 2, False, f"x{n}") for n in range(5)]
    assert "BroadcastNestedLoopJoin" not in edits.set_groups(columns, ranges)._jdf.queryExecution().toString()


def test_ranges_against_a_plain_loop(spark):
    rnd = random.Random(3)
    old = {(p, n): rnd.choice([None, 50 + n]) for p in range(4) for n in range(12)}
    made = [(p, low, rnd.randint(low - 1, 12), rnd.choice([None, k]), k) for p in range(4) for k, low in enumerate(rnd.choices(range(12), k=rnd.randint(0, 6)))]
    made += made[:3]  # repeated edits
    columns = spark.createDataFrame([(p, n, g) for (p, n), g in old.items()], "passage_id long, n int, group_id int")
    ranges = spark.createDataFrame(made, "passage_id long, low int, high int, group_id int, ord int")
    want = dict(old)
    for p, low, high, group, _ in sorted(made, key=lambda r: r[4]):
        want |= {(p, n): group for n in range(low, high + 1) if (p, n) in want}
    assert {(r["passage_id"], r["n"]): r["group_id"] for r in edits.set_groups(columns, ranges).collect()} == want
    assert edits.set_groups(columns, ranges.where("false")).count() == len(old)


def test_emended_stays_and_columns_go_along(spark):
    cells = spark.createDataFrame([("p", "A", 0, 0, "x", "l", True, 7), ("p", "A", 0, 1, "y", None, None, 8), ("p", "R", 1, 0, "z", "m", None, 9), ("p", "R", 1, 1, "w", None, True, 10)], "passage_id string, siglum string, wit_ord int, n int, reading string, lemma string, emended boolean, further int")
    made = spark.createDataFrame([("R",), ("R",)], "siglum string")
    new = spark.createDataFrame([("p", "A", 0, "X"), ("p", "R", 0, "Z")], "passage_id string, siglum string, n int, new_reading string")
    got = sorted(tuple(r) for r in edits.apply_cell_edits(cells, new, made).collect())
    assert got == [("p", "A", 0, 0, "X", None, True, 7), ("p", "A", 0, 1, "y", None, False, 8), ("p", "R", 1, 0, "Z", None, True, 9), ("p", "R", 1, 1, "w", None, True, 10)]
