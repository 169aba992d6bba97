"""Barcode and annotation text parsing as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exprstudy.constants import (
    BARCODE_PATTERN,
    COMPACT_PATTERN,
    FALSE_WORDS,
    MISSING_WORDS,
    PARTICIPANT_PATTERN,
    PRIMARY_SAMPLE_CODE,
    TRUE_WORDS,
)
from exprstudy.functions.budgets import ALL, BUDGET
from exprstudy.functions.checks import fail_when

NUMBER_PATTERN = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def clean_barcode(col: Column) -> Column:
    return F.upper(F.trim(col))


def expand_compact(col: Column) -> Column:
    """Split a fused sample/portion field: six fields with a fourth like 06A21 become seven."""
    return F.regexp_replace(clean_barcode(col), COMPACT_PATTERN, "$1-$2")


def barcode_struct(col: Column, strict: bool = True) -> Column:
    """Parse a barcode to ``raw, participant, sample, sample_type_code, vial, is_primary, error``.

    ``strict`` fails the job on a bad barcode; otherwise the parts are null and
    ``error`` names the reason.
    """
    raw = clean_barcode(col)
    good = F.coalesce(raw.rlike(BARCODE_PATTERN), F.lit(False))
    if strict:
        # every part derives from this column, so a bad barcode fails whichever part is used
        message = F.concat(F.lit("invalid barcode: "), F.coalesce(raw, F.lit("null")))
        valid = fail_when(~good, message, raw)
        error = F.lit(None).cast("string")
    else:
        valid = F.when(good, raw)
        fields = F.split(raw, "-")
        error = F.when(
            ~good,
            F.when(raw.isNull() | (F.size(fields) < 3), F.lit("too_few_fields"))
            .when(~F.concat_ws("-", F.slice(fields, 1, 3)).rlike(PARTICIPANT_PATTERN), F.lit("bad_participant"))
            .otherwise(F.lit("bad_sample_field")),
        )
    # the checked pattern fixes the position of every part
    has_sample = F.length(valid) > 12
    code = F.when(has_sample, F.substring(valid, 14, 2))
    vial = F.substring(valid, 16, 1)
    return F.struct(
        (valid if strict else raw).alias("raw"),
        F.substring(valid, 1, 12).alias("participant"),
        F.when(has_sample, F.substring(valid, 1, 15)).alias("sample"),
        code.alias("sample_type_code"),
        F.when(has_sample & ~vial.isin("-", ""), vial).alias("vial"),
        F.coalesce(code == PRIMARY_SAMPLE_CODE, F.lit(False)).alias("is_primary"),
        error.alias("error"),
    )


def parse_bool(col: Column, strict: bool = True) -> Column:
    word = F.lower(F.trim(F.coalesce(col, F.lit(""))))
    known = F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    if not strict:
        return known
    return fail_when(known.isNull(), F.concat(F.lit("cannot parse boolean value: "), word), known)


def unquote(col: Column) -> Column:
    """Undo the quoting of one delimited-text field."""
    inner = F.regexp_replace(F.regexp_extract(col, '^"(?s)(.*)"$', 1), '""', '"')
    return F.when(col.rlike('^"(?s).*"$'), inner).otherwise(col)


def gene_id_struct(col: Column) -> Column:
    """``symbol|entrez`` split at the first pipe; without one the second part is empty."""
    parts = F.split(F.trim(col), "\\|", 2)
    return F.struct(
        F.trim(parts[0]).alias("symbol"),
        F.coalesce(F.trim(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("entrez_id"),
    )


def parse_number(col: Column, strict: bool = True) -> Column:
    """Text to FLOAT with blank, NA and nan as NaN; other junk fails (strict) or is null.

    Only decimal numbers and infinities are numbers: a cast alone would also take Java's
    type suffixes and hexadecimal floats.
    """
    text = F.trim(col)
    missing = F.lower(text).isin(*MISSING_WORDS)
    plain = F.when(text.rlike(NUMBER_PATTERN), text)
    value = F.when(missing, F.lit("NaN")).otherwise(plain).try_cast("float")
    if not strict:
        return value
    unreadable = col.isNotNull() & value.isNull()
    return fail_when(unreadable, F.concat(F.lit("not a number: "), text), value)


def budget_value(col: Column) -> Column:
    """Text budget to ``kind`` (all, count, invalid) and ``k`` (null unless a count)."""
    k = F.regexp_extract(col, BUDGET, 2).try_cast("int")
    kind = F.when(k.isNotNull(), F.lit("count")).when(col.rlike(BUDGET), F.lit(ALL)).otherwise(F.lit("invalid"))
    return F.struct(kind.alias("kind"), k.alias("k"))
