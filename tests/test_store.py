import pytest
from pyspark.sql import functions as F

from tessera.sources.store import Conflict, Store, read_csv


def test_store(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, t int")
    assert st.ensure({"a": a.schema, "b": a.schema}) == ["a", "b"] and st.ensure({"a": a.schema}) == [] and st.count("a") == 0
    st.write({"a": a, "b": a.limit(1)})
    assert st.names() == ["a", "b"] and st.count("a") == 2 and st.get("a", "id", 2).first().v == "y"
    old = st.table("a")
    st.upsert("a", spark.createDataFrame([(2, "z", 2), (3, "n", 1), (1, "late", 0)], "id int, v string, t int"), ["id"], "t")
    assert sorted((r.id, r.v) for r in st.table("a").collect()) == [(1, "x"), (2, "z"), (3, "n")]
    assert old.count() == 2  # what was read before stays as it was
    assert [r.id for b in st.batches("a", "id", 2) for r in b.orderBy("id").collect()] == [1, 2, 3] and len(list(st.batches("a", "id", 2))) == 2
    other = Store(spark, st.path)
    version, state = other._state()
    st.clear("b")
    with pytest.raises(Conflict):
        other._put(version + 1, state)
    assert st.count("b") == 0 and st.count("a") == 3 and sorted(r.id for r in st.keys("a", ["id"]).collect()) == [1, 2, 3]
    assert st.vacuum() >= 4 and st.count("a") == 3 and st.vacuum() == 0


def test_a_failed_transaction_changes_nothing(spark, tmp_path):
    st = Store(spark, f"file://{tmp_path}/s")
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    st.write({"a": a})
    with pytest.raises(Exception):
        st.write({"a": a.limit(0), "b": a.select(F.raise_error(F.lit("no")).alias("x"))})
    assert st.names() == ["a"] and st.count("a") == 1


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id;price;day;note\n1;1.234,5;03/01/2024;"a; ""b"""\n2;NA;31/12/2023;\n3;many;2024-01-01;c\n')
    rows = read_csv(spark, f"file://{p}", "day date, id int, price double", sep=";", decimal_comma=True, date="dd/MM/yyyy").orderBy("id").collect()
    assert [(r.id, r.price, str(r.day), r._bad) for r in rows] == [(1, 1234.5, "2024-01-03", 0), (2, None, "2023-12-31", 0), (3, None, "None", 2)]
