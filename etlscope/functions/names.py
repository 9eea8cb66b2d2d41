"""Names, warehouse layers and type strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rule packages and warehouses in question use.
LAYERS = (
    ("ODS", r"\bods\b|(^|\.)ods_"),
    ("DIM", r"\bdim\b|(^|\.)dim_"),
    ("DWB", r"\b(dwb|dwd)\b|(^|\.)(dwb_|dwd_|dwl_)"),
    ("DWS", r"\bdws\b|(^|\.)dws_"),
    ("ADS", r"\b(ads|rpt|slprd)\b|(^|\.)(ads_|rpt_)"),
    ("TMP", r"\b(tmp|temp)\b|(^|\.)(tmp_|temp_)"),
)
ORACLE_MARKS = ("(+)", "NVL(", "DECODE(", "VARCHAR2", "NUMBER(", "CONNECT BY", "ROWNUM", "SYSDATE")
DWS_MARKS = ("DISTRIBUTE BY", "TO GROUP", "ORIENTATION=", "COMPRESSION=", "WITHOUT TIME ZONE")
FAMILIES = {
    "integer": ("int", "integer", "bigint", "smallint", "tinyint", "int2", "int4", "int8", "serial"),
    "varchar": ("varchar", "character", "char", "text", "string", "nvarchar", "nvarchar2", "varchar2", "character varying"),
    "numeric": ("numeric", "decimal", "number", "float", "double", "real", "float4", "float8", "precision", "double precision"),
    "datetime": ("date", "timestamp", "time", "datetime", "timestamp without time zone"),
    "boolean": ("boolean", "bool"),
}
#: Decimal digits that an integer type may need.
INTEGER_DIGITS = {"bigint": 19, "int8": 19, "smallint": 5, "int2": 5, "tinyint": 3}
DEFAULT_DIGITS = 10


def normal(name: Column) -> Column:
    """Lower-case, trimmed."""
    return F.lower(F.trim(name))


def full_name(schema: Column, table: Column) -> Column:
    """schema.table, or table alone where the schema is empty."""
    s, t = normal(F.coalesce(schema, F.lit(""))), normal(table)
    return F.when(s == "", t).otherwise(F.concat_ws(".", s, t))


def short_name(name: Column) -> Column:
    """The last part of a dotted name."""
    return F.element_at(F.split(normal(name), r"\."), -1)


def match_kind(a: Column, b: Column) -> Column:
    """How two table names match: full, or short where only the last parts are equal; null if they do not."""
    return F.when(normal(a) == normal(b), "full").when(short_name(a) == short_name(b), "short")


def is_intermediate(name: Column) -> Column:
    """Whether the table name marks a temporary table."""
    # fixed value: the naming rule for temporary tables
    return short_name(name).rlike(r"^(tmp|temp)(\d*$|_)|_(tmp|temp)(\d*$|_)")


def layer(name: Column) -> Column:
    out = F.lit("UNKNOWN")
    for label, pattern in reversed(LAYERS):
        out = F.when(normal(name).rlike(pattern), label).otherwise(out)
    return out


def dialect(joined_sql: Column) -> Column:
    """oracle if strictly more of its marks occur, else dws."""
    count = lambda marks: sum((F.when(F.contains(F.upper(joined_sql), F.lit(m)), 1).otherwise(0) for m in marks), F.lit(0))
    return F.when(count(ORACLE_MARKS) > count(DWS_MARKS), "oracle").otherwise("dws")


def type_base(kind: Column) -> Column:
    """The type word without length, lower-case, inner spaces single."""
    return F.regexp_replace(F.trim(F.split(F.lower(F.trim(kind)), r"\(")[0]), r"\s+", " ")


def type_family(kind: Column) -> Column:
    out = F.lit("unknown")
    for family, spellings in FAMILIES.items():
        out = F.when(type_base(kind).isin(*spellings), family).otherwise(out)
    return out


def type_length(kind: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(kind, r"\(\s*(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def type_scale(kind: Column) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(kind, r"\(\s*\d+\s*,\s*(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int")


def compatible(source: Column, target: Column) -> Column:
    """Whether the target type can hold every value of the source type; unknown lengths count as enough."""
    sf, tf = type_family(source), type_family(target)
    sl, tl, ss, ts = type_length(source), type_length(target), type_scale(source), type_scale(target)
    digits = F.lit(DEFAULT_DIGITS)
    for base, n in INTEGER_DIGITS.items():
        digits = F.when(type_base(source) == base, n).otherwise(digits)
    scale_ok = ss.isNull() | ts.isNull() | (ts >= ss)
    return (
        F.when((sf == "integer") & (tf == "integer"), True)
        .when((sf == "integer") & (tf == "numeric"), tl.isNull() | (tl >= F.coalesce(sl, digits)))
        .when(sf != tf, False)
        .when(tl.isNull() | sl.isNull(), True)
        .when(sf == "varchar", tl >= sl)
        .when(sf == "numeric", (tl >= sl) & scale_ok)
        .otherwise(True)
    )
