import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from exprstudy.functions import barcodes as bc
from exprstudy.functions.budgets import parse_budget, parse_budgets
from exprstudy.functions.checks import find_columns, require_columns


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_full_barcode(spark):
    got = one(spark, bc.barcode_struct, " tcga-ab-1234-01b-11r-a123-07 ")
    assert got["participant"] == "TCGA-AB-1234"
    assert got["sample"] == "TCGA-AB-1234-01"
    assert (got["sample_type_code"], got["vial"], got["is_primary"]) == ("01", "B", True)


def test_participant_only_and_vial_missing(spark):
    got = one(spark, bc.barcode_struct, "TCGA-AB-1234")
    assert got["participant"] == "TCGA-AB-1234" and got["sample"] is None and not got["is_primary"]
    got = one(spark, bc.barcode_struct, "TCGA-AB-1234-11")
    assert got["sample"] == "TCGA-AB-1234-11" and got["vial"] is None
    got = one(spark, bc.barcode_struct, "TCGA-AB-1234-11-01R")
    assert got["sample"] == "TCGA-AB-1234-11" and got["vial"] is None


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("TCGA-AB", "too_few_fields"),
        ("XCGA-AB-1234-01A", "bad_participant"),
        ("TCGA-AB-12345", "bad_participant"),
        ("TCGA-AB-1234-1A", "bad_sample_field"),
        ("TCGA-AB-1234-01AB", "bad_sample_field"),
        (None, "too_few_fields"),
    ],
)
def test_bad_barcodes(spark, text, reason):
    got = one(spark, lambda c: bc.barcode_struct(c, strict=False), text)
    assert got["error"] == reason and got["participant"] is None and got["sample"] is None
    # a strict parse fails whichever part is used
    for part in ("participant", "sample", "is_primary"):
        with pytest.raises(PySparkException, match="invalid barcode"):
            one(spark, lambda c, p=part: bc.barcode_struct(c)[p], text)


def test_compact_repair(spark):
    assert one(spark, bc.expand_compact, "tcga-aa-1234-06A21-D123-07") == "TCGA-AA-1234-06A-21-D123-07"
    kept = "TCGA-AA-1234-06A-21D-D123-07"
    assert one(spark, bc.expand_compact, kept) == kept
    assert one(spark, bc.expand_compact, "TCGA-AA-1234-06A21") == "TCGA-AA-1234-06A21"


def test_booleans(spark):
    for text in ("TRUE", " t ", "1", "Yes", "y"):
        assert one(spark, bc.parse_bool, text) is True
    for text in ("false", "F", "0", "no", "N", "", None):
        assert one(spark, bc.parse_bool, text) is False
    assert one(spark, lambda c: bc.parse_bool(c, strict=False), "maybe") is None
    with pytest.raises(PySparkException, match="boolean"):
        one(spark, bc.parse_bool, "maybe")


def test_numbers(spark):
    for text in ("", "NA", "nan", "NaN", " na "):
        assert one(spark, bc.parse_number, text) != one(spark, bc.parse_number, text)
    assert one(spark, bc.parse_number, " 1.5 ") == 1.5
    with pytest.raises(PySparkException):
        one(spark, bc.parse_number, "abc")
    # words that a cast takes but that are no decimal numbers
    for text in ("abc", "1d", "1.5f", "0x1p3", "1e", ".", "1 2"):
        assert one(spark, lambda c: bc.parse_number(c, strict=False), text) is None
    for text, value in (("-2", -2.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("-inf", float("-inf"))):
        assert one(spark, bc.parse_number, text) == value


def test_gene_ids_and_quotes(spark):
    for text, symbol, entrez in (("?|100", "?", "100"), ("TP53|7157|x", "TP53", "7157|x"), ("SOLO", "SOLO", "")):
        got = one(spark, bc.gene_id_struct, text)
        assert (got["symbol"], got["entrez_id"]) == (symbol, entrez)
    assert one(spark, bc.unquote, '"a ""b"""') == 'a "b"'
    assert one(spark, bc.unquote, "plain") == "plain"


def test_budgets(spark):
    assert [parse_budget(v) for v in (5, "20", " ALL ")] == [5, 20, "all"]
    for bad in (0, "-3", "many", True, "1.5", "", None):
        with pytest.raises(ValueError):
            parse_budget(bad)
    with pytest.raises(ValueError, match="duplicates"):
        parse_budgets([5, "5"])
    assert tuple(one(spark, bc.budget_value, " All ")) == ("all", None)
    assert tuple(one(spark, bc.budget_value, "7")) == ("count", 7)
    assert tuple(one(spark, bc.budget_value, "x")) == ("invalid", None)


def test_column_aliases(spark):
    columns = ["Aliquot Barcode", "Do-Not_use", "Acronym"]
    wanted = {"flag": ("do_not_use",), "class": ("cancer type", "acronym")}
    assert find_columns(columns, wanted) == {"flag": "Do-Not_use", "class": "Acronym"}
    with pytest.raises(ValueError, match="flag .* class"):
        find_columns(["a"], wanted)
    with pytest.raises(ValueError, match="must contain"):
        require_columns(spark.range(1), ["x"])
