import json
from datetime import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from bundleflow.operators.registry import HEADER_SPELLINGS, clean_registry, map_aliases, plan_headers
from bundleflow.plans.registry_load import load_registry, load_registry_file
from bundleflow.schemas import REGISTRY, REGISTRY_DATA
from bundleflow.sources.registry import scan_registry
from bundleflow.sources.tables import read_latest

T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def sheet(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_all_targets_and_spellings_known():
    assert set(HEADER_SPELLINGS) == set(REGISTRY_DATA.fieldNames())
    assert sum(len(v) for v in HEADER_SPELLINGS.values()) == len({s for v in HEADER_SPELLINGS.values() for s in v})


def test_later_alias_wins_even_when_null(spark):
    df = sheet(spark, [("5", "01/02/2000", None)], ["RegNo", "DOB", "Date Of Birth"])
    assert clean_registry(df).first()["date_of_birth"] is None


def test_correct_district_wins_over_misspelling(spark):
    df = sheet(spark, [("5", "right", "wrong")], ["RegNo", "District", "Distrinct"])
    assert map_aliases(df).first()["district"] == "right"
    only_typo = sheet(spark, [("5", "kept")], ["RegNo", "Distrinct"])
    assert map_aliases(only_typo).first()["district"] == "kept"


def test_key_column_required_and_unmapped_reported():
    with pytest.raises(ValueError, match="registration_no"):
        plan_headers(["name", "dob"])
    assert plan_headers(["Reg No", "Shoe Size"]).unmapped == ("Shoe Size",)


def test_search_record_never_null(spark):
    df = sheet(spark, [("7.0", " Ashish ", "null", "PATIL", None)], ["RegNo", "FName", "MName", "Surname", "College"])
    row = clean_registry(df).select(F.to_json("fields_norm").alias("j")).first()
    assert json.loads(row["j"]) == {
        "registration_no": "7", "full_name": "ashish patil", "name_change": "", "dob": "", "qualification": "",
        "college": "", "university": "", "district": "",
    }


def test_counts_observed(spark):
    seen = Observation("load")
    clean_registry(sheet(spark, [("1",), ("x",), ("",)], ["RegNo"]), seen).count()
    assert seen.get == {"loaded": 1, "skipped_no_key": 2}


def test_reload_keeps_id_and_created_at(spark):
    target = spark.createDataFrame([], REGISTRY)
    first = load_registry(sheet(spark, [("1", "a"), ("2", "b")], ["RegNo", "FName"]), target, T1).table
    second = load_registry(sheet(spark, [("2", None), ("3", "c")], ["RegNo", "FName"]), first, T2).table
    rows = {r["registration_no"]: r for r in second.collect()}
    assert rows[2]["f_name"] is None  # full overwrite, null included
    assert (rows[2]["created_at"], rows[2]["updated_at"]) == (T1, T2)
    assert rows[1]["updated_at"] == T1 and rows[3]["created_at"] == T2
    assert rows[2]["id"] == {r["registration_no"]: r["id"] for r in first.collect()}[2]


def test_dry_run_merges_nothing(spark):
    out = load_registry(sheet(spark, [("1", "a"), ("2", "b")], ["RegNo", "FName"]), spark.createDataFrame([], REGISTRY), T1, dry_run=True)
    assert out.table is None and out.rows == 2 and out.sample is not None


def test_load_csv_file_twice(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("Registration No,First Name,DOB\n5,Asha,26/02/1996\nx,Nobody,\n")
    scanned = scan_registry(spark, str(path))
    assert {f.dataType.simpleString() for f in scanned.schema} == {"string"}
    root = str(tmp_path / "registry")
    assert load_registry_file(spark, str(path), root, T1) == {"loaded": 1, "skipped_no_key": 1}
    load_registry_file(spark, str(path), root, T2)
    table = read_latest(spark, root, REGISTRY)
    assert [(r["registration_no"], r["date_of_birth"], r["created_at"]) for r in table.collect()] == [(5, "1996-02-26", T1)]


def test_repeated_numbers_in_a_sheet_keep_the_last_row(spark, tmp_path):
    path, root = tmp_path / "sheet.csv", str(tmp_path / "table")
    path.write_text("RegistrationNo,FName\n" + "".join(f"{n},row{i}\n" for i, n in enumerate([5, 6, 5, 7, 5, 6])))
    for stamp in (T1, T2, T2):
        load_registry_file(spark, str(path), root, stamp)
        rows = {r.registration_no: r.f_name for r in read_latest(spark, root, REGISTRY).collect()}
        assert rows == {5: "row4", 6: "row5", 7: "row3"} and read_latest(spark, root, REGISTRY).count() == 3
