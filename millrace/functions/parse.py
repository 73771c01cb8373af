"""Event encoding: JSON text to typed rows and back. A record that doesn't decode is dropped, an absent or null field takes its zero value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EVENT

ZERO = {"event_id": "", "key": "", "event_type": "", "amount": 0.0, "event_time": 0, "ingest_time": 0}
KIND = {n: EVENT[n].dataType.simpleString() for n in ZERO}
#: The JSON types that a field of a Spark type takes.
TAKES = {"string": ["STRING"], "double": ["DOUBLE", "BIGINT", "DECIMAL"], "bigint": ["BIGINT"]}
_TEXT, _REAL, _INT = ("|".join(n for n in ZERO if KIND[n] == k) for k in ("string", "double", "bigint"))
_MEMBER = rf'\s*"(?:(?:{_TEXT})"\s*:\s*"[^"\\]*+"|(?:{_REAL})"\s*:\s*-?[0-9]{{1,17}}(?:\.[0-9]{{1,17}})?|(?:{_INT})"\s*:\s*-?[0-9]{{1,18}})\s*'
#: Records as producers write them: known names, plain values of the right types. Spark's typed parser reads these as they are meant.
PLAIN = rf"\A\s*\{{{_MEMBER}(?:,{_MEMBER})*+\}}\s*\z"


def encode(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct(*EVENT.fieldNames())).alias(column))


def members(value: Column) -> Column:
    """map of the object's members, by name as written; null if the text isn't an object. The text null is an object without members."""
    v = F.from_json(value, "map<string,variant>", {"mode": "PERMISSIVE"})
    whole = F.when(value.rlike(r"\}\s*\z"), v)  # what follows the object makes it corrupt
    return F.when(value.rlike(r"\A\s*null\s*\z"), F.expr("cast(map() as map<string,variant>)")).otherwise(whole)


def last(entries: Column, name: str) -> Column:
    own = F.filter(entries, lambda x: x["name"] == name)
    return F.when(F.size(own) > 0, F.element_at(own, -1))


def checked(value: Column) -> Column:
    """struct (ok, fields) by the JSON types of the members; null if the text isn't an object."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0)
    entries = F.transform(F.map_entries(members(value)), lambda x: F.struct(F.lower(x["key"]).alias("name"), x["value"].alias("v"), kind(x["value"]).alias("t")))
    # each step is bound by a one-element array, so that it is computed once
    picked = F.transform(F.array(entries), lambda e: F.struct(*(last(e, n).alias(n) for n in ZERO), e.isNotNull().alias("there")))

    def typed(p: Column) -> Column:
        ok, out = p["there"], []
        for n, z in ZERO.items():
            got = F.try_variant_get(p[n]["v"], "$", KIND[n])
            real = F.abs(got) < float("inf") if KIND[n] == "double" else F.lit(True)
            ok = ok & (p[n].isNull() | (p[n]["t"] == "VOID") | (p[n]["t"].isin(TAKES[KIND[n]]) & F.coalesce(real, F.lit(False))))
            out.append(F.coalesce(got, F.lit(z).cast(KIND[n])).alias(n))
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), *out)

    return F.element_at(F.transform(picked, typed), 1)


def decode(df: DataFrame, column: str = "value", *, stamp: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose text is null, empty or corrupt, or has a field of a wrong type, are skipped. Names match in any case, the last of equal ones counts, other names are passed over.
    A number isn't a string, a text isn't a number, and 1.0 isn't an integer. Plain records take the short way, all others are checked. stamp=True overwrites ingest_time with the read time."""
    value = F.col(column)
    rows = df.select(*keep, value.alias("_v"), value.rlike(PLAIN).alias("_plain"))
    both = rows.select(*keep, "_plain", F.when(F.col("_plain"), F.from_json("_v", EVENT)).alias("_a"), F.when(~F.col("_plain"), checked(F.col("_v"))).alias("_b"))
    out = both.where(F.col("_plain") | F.col("_b.ok")).select(*keep, *(F.coalesce(f"_a.{n}", f"_b.{n}", F.lit(z).cast(KIND[n])).alias(n) for n, z in ZERO.items()))
    return out.withColumn("ingest_time", F.unix_millis(F.current_timestamp())) if stamp else out
