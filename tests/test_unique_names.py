"""Names made unique by one pass against rounds in which each loser tries its next number."""

import random

from tallyforge.operators.schema_rules import unique_names


def in_rounds(rows):
    """rows: (template, pos, name); the first holder of a name keeps it, a name as it is written before a numbered one."""
    now = {(t, p): (n, 1, n) for t, p, n in rows}
    while True:
        held, lost = {}, False
        for (t, p), (name, k, mine) in now.items():
            held.setdefault((t, mine), []).append((k > 1, p))
        for (t, p), (name, k, mine) in list(now.items()):
            if mine is not None and min(held[t, mine]) != (k > 1, p):
                now[t, p], lost = (name, k + 1, f"{name}_{k + 1}"), True
        if not lost:
            return {k: v[2] for k, v in now.items()}


def test_names_equal_rounds(spark):
    rng = random.Random(3)
    names = ["a", "a", "a", "a_2", "a_3", "a_2_2", "a_5", "a_02", "b", "b_1", "b_2", "a_3", None]
    rows = [(t, p, rng.choice(names)) for t in [*range(20), None] for p in range(rng.randrange(1, 25))]
    got = unique_names(spark.createDataFrame(rows, "t int, pos int, name string").repartition(6), ["t"], "pos", "name").collect()
    assert {(r.t, r.pos): r.unique for r in got} == in_rounds(rows) and len(got) == len(rows)


def test_a_name_that_many_have(spark):
    """Each further holder of a name took a round of its own before."""
    df = spark.range(5000).selectExpr("id % 2 AS t", "id AS pos", "if(id = 4, 'f_3', 'f') AS name")
    got = {(r.t, r.pos): r.unique for r in unique_names(df, ["t"], "pos", "name").collect()}
    assert got[1, 1] == "f" and got[1, 4999] == "f_2500" and got[0, 4] == "f_3"
    assert [got[0, p] for p in (0, 2, 6, 4998)] == ["f", "f_2", "f_4", "f_2500"] and len(set(got.items())) == 5000
