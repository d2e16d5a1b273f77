"""Documents without an id, and different texts that share one, are neither lost nor left as they are."""

import pytest

pytest.importorskip("tallyforge.llm")

from tallyforge.llm import minhash, pii  # noqa: E402


def test_stage_keeps_rows_without_an_id(spark):
    said = lambda w, n=60: " ".join(f"{w}{i}" for i in range(n))
    rows = [(None, said("a")), (None, said("b")), (1, said("c")), (None, said("c") + " tail"), (2, said("d")), (2, said("e")), (3, said("e")), (4, said("f")), (5, said("f")), (None, None), (None, said("g")), (None, said("g") + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in minhash.stage(spark, df, "").collect()]
    assert {x for x in got if not (x[1] or "").startswith("g")} == {rows[i] for i in (0, 1, 2, 4, 5, 7, 9)}
    assert len(got) == 8 and sum((t or "").startswith("g") for _, t in got) == 1
    all_rows = minhash.near_duplicates(df).collect()
    assert len(all_rows) == len(rows) and all(r.kept is not None for r in all_rows)


def test_private_data_of_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "mail ann@mail.example.com"), (None, "card 4111 1111 1111 1111"), (1, "mail ann@mail.example.com")], "doc_id long, text string")
    got = pii.replace_pii(df, "key").collect()
    assert [r.n_entities for r in got] == [1, 1, 1] and not any("ann@" in r.text or "4111 1111" in r.text for r in got)
    assert len({r.text for r in got}) == 2
