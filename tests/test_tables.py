"""The catalogue of typed tables: profile, create, replace, list, look up, read during a replacement."""

import random

import pytest

from corpusloom.operators import inference as I
from corpusloom.sources import tables as TB

REGISTRY = I.Registry([I.currency(), I.percent()], [lambda n: "price" if "price" in n.lower() else None])


def test_profile(spark):
    rows = [(k, "yes" if k % 2 else "No", f"2024-01-{1 + k % 28:02d}" if k % 10 else "soon", str(k) if k % 6 else "n/a", f"{k}.5", f"${k}", f"word{k}", None, "-") for k in range(50)]
    names = ["i", "flag", "day", "whole", "part", "Price", "text", "none", "marks"]
    got = {r["column"]: r for r in TB.profile(spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names)).repartition(4), "i", REGISTRY).collect()}
    assert {k: r.type for k, r in got.items()} == {"flag": "boolean", "day": "date", "whole": "integer", "part": "real", "Price": "currency", "text": "text", "none": "text", "marks": "text"}
    whole = sorted(k for k in range(50) if k % 6)
    assert (got["whole"].null_count, got["whole"].distinct_count, got["whole"].min, got["whole"].max, got["whole"].sum, got["whole"]["count"]) == (9, 41, 1, 49, sum(whole), 41)
    assert [got["whole"][f"p{p}"] for p in (25, 50, 75)] == [whole[round(p / 100 * 40)] for p in (25, 50, 75)]
    assert (got["day"].first_date, got["day"].last_date) == ("2024-01-01", "2024-01-28") and (got["none"].null_count, got["marks"].null_count, got["text"].min) == (50, 50, None)


def test_profile_looks_at_the_first_values_in_order(spark):
    rows = [(k, str(k) if k < 2500 else "word", None if k < 100 else "1") for k in range(10_000)]
    random.Random(1).shuffle(rows)
    got = {r["column"]: r for r in TB.profile(spark.createDataFrame(rows, "i int, a string, b string").repartition(7), "i").collect()}
    assert (got["a"].type, got["a"]["count"], got["a"].max, got["b"].null_count, got["b"]["count"]) == ("integer", 2000, 1999.0, 100, 2000)


def test_mixed_formats_are_real(spark):
    rows = [("$10",), ("20",), ("$30",), ("40",), ("(50)",)]
    assert TB.profile(spark.createDataFrame(rows, "a string"), registry=REGISTRY).first().type == "real"


@pytest.fixture
def catalogue(spark, tmp_path):
    return TB.Tables(spark, str(tmp_path / "tables"), REGISTRY)


def frame(spark, n, extra=""):
    return spark.createDataFrame([(n - k, str(k), f"${k}.50", f"name {k}{extra}") for k in range(n)], "at int, `Item No` string, `Unit price` string, `item-no` string").repartition(3)


def test_create_read_and_replace(spark, catalogue):
    assert catalogue.tables().collect() == [] and catalogue.schema("x") is None
    entry = catalogue.create("doc 1", "b.csv", frame(spark, 20), order="at")
    assert entry["table_name"] == "csv_data_doc_1" and entry["row_count"] == 20
    assert [(c["name"], c["sql_name"], c["type"], c["role"], c["raw_sql_name"]) for c in entry["columns"]] == [("Item No", "Item_No", "integer", None, "Item_No__raw"), ("Unit price", "Unit_price", "currency", "price", "Unit_price__raw"), ("item-no", "item_no_2", "text", None, None)]
    old = catalogue.read("csv_data_doc_1")
    rows = sorted(old.collect(), key=lambda r: r["__row_number"])
    assert [r["__row_number"] for r in rows] == list(range(1, 21)) and [r.Item_No for r in rows] == list(range(19, -1, -1)) and rows[0].Unit_price == 19.5 and rows[0].Unit_price__raw == "$19.50"
    catalogue.create("doc 1", "c.csv", frame(spark, 5, "x"), order="at", roles={"Item No": "key"}, types={"Item No": "text"})
    assert old.count() == 20 and catalogue.read("csv_data_doc_1").count() == 5  # a reader of before reads on
    assert catalogue.schema("csv_data_doc_1")["columns"][0]["type"] == "text" and catalogue.read("csv_data_doc_1", 1).count() == 20
    assert catalogue.vacuum("csv_data_doc_1") == 1 and catalogue.read("csv_data_doc_1").count() == 5


def test_list_look_up_and_hide(spark, catalogue):
    for document, file, sheet in (("d2", "b.csv", ""), ("d1", "a.xlsx", "two"), ("d1", "a.xlsx", "one")):
        catalogue.create(document, file, frame(spark, 3).drop("at"), sheet)
    assert [(r.filename, r.sheet_name) for r in catalogue.tables().collect()] == [("a.xlsx", "one"), ("a.xlsx", "two"), ("b.csv", "")]
    assert [catalogue.schema(*x)["table_name"] for x in (("d1",), ("a.xlsx", "filename"), ("csv_data_d2", "table_name"), ("d2", "document_id"))] == ["csv_data_d1_one", "csv_data_d1_one", "csv_data_d2", "csv_data_d2"]
    assert catalogue.schema("d1", "filename") is None
    with pytest.raises(ValueError):
        catalogue.schema("d1", "sheet")
    catalogue.hide("csv_data_d2")
    assert [r.table_name for r in catalogue.tables().collect()] == ["csv_data_d1_one", "csv_data_d1_two"] and catalogue.tables(hidden=True).count() == 3
    assert "csv_data_d2" in catalogue.suggest("data-d2") and TB.column_rows(catalogue.entries()).count() == 9
    with pytest.raises(KeyError):
        catalogue.hide("nothing")


def test_failed_writer_changes_nothing(spark, catalogue):
    catalogue.create("d", "a.csv", frame(spark, 4).drop("at"))
    broken = frame(spark, 4).drop("at").selectExpr("CASE WHEN `Item No` = '2' THEN raise_error('x') ELSE `Item No` END AS a")
    with pytest.raises(Exception):
        catalogue.create("d", "a.csv", broken)
    assert catalogue.read("csv_data_d").count() == 4 and catalogue.schema("d")["column_count"] == 3


def test_empty_table(spark, catalogue):
    entry = catalogue.create("d", "a.csv", frame(spark, 4).filter("false").drop("at"))
    assert entry["row_count"] == 0 and catalogue.read("csv_data_d").collect() == []
    with pytest.raises(ValueError):
        catalogue.create("e", "a.csv", spark.range(3), order="id")
