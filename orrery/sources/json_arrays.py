"""JSON sources: parallel arrays, nested regions, header matrices, maps of records, schema drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def transpose(rows: DataFrame, keys: list[str], arrays: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of parallel arrays: position and one value an array.

    A block whose arrays differ in length, or of which one is missing, goes to quarantine
    whole; nothing is cut or padded.
    """
    sizes = F.array(*(F.when(F.col(a).isNotNull(), F.size(a)).otherwise(-1) for a in arrays))
    same = (F.array_min(sizes) == F.array_max(sizes)) & (F.array_min(sizes) >= 0)
    marked = rows.withColumn("orrery_same", same).withColumn("orrery_sizes", sizes)
    good = marked.where("orrery_same").select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("position", "r")).select(*keys, "position", *(F.col(f"r.{a}").alias(a) for a in arrays))
    bad = marked.where("NOT orrery_same").select(*keys, F.lit("UNEQUAL_ARRAYS").alias("reason"), F.array_join(F.transform("orrery_sizes", lambda s: s.cast("string")), ",").alias("sizes"))
    return good, bad


def region_verdict(document: Column, path: str) -> Column:
    """missing, wrong_type, malformed, valid_empty or valid of an object region of a JSON text; an empty one is a true zero."""
    whole, value = F.try_parse_json(document), F.get_json_object(document, path)
    return F.when(whole.isNull(), "malformed").when(value.isNull(), "missing").when(~F.startswith(F.ltrim(value), F.lit("{")), "wrong_type").when(F.regexp_replace(value, r"\s", "") == "{}", "valid_empty").otherwise("valid")


def schema_drift(document: Column, required: list[str], optional: list[str]) -> Column:
    """struct<missing, unknown, verdict> of a JSON object's keys against a contract; unknown keys are reported, never dropped."""
    keys = F.json_object_keys(document)
    none = F.array().cast("array<string>")
    want = F.array(*map(F.lit, required)) if required else none
    known = F.array(*map(F.lit, [*required, *optional]))
    missing, unknown = F.array_sort(F.array_except(want, F.coalesce(keys, none))), F.array_sort(F.array_except(F.coalesce(keys, none), known))
    verdict = F.when(keys.isNull(), "not_an_object").when(F.size(missing) > 0, "missing_required").when(F.size(unknown) > 0, "unknown_fields").otherwise("as_contracted")
    return F.struct(F.array_join(missing, "+").alias("missing"), F.array_join(unknown, "+").alias("unknown"), verdict.alias("verdict"))


def header_matrix(rows: DataFrame, keys: list[str], fields: str, data: str, columns: list[str]) -> DataFrame:
    """keys, one column a name, from an array of names and an array of value arrays; a document without one of the names fails as a whole."""
    places = [F.array_position(fields, c) for c in columns]
    ok = F.lit(True)
    for p in places:
        ok = ok & (p > 0)
    good = rows.where(ok).select(*keys, *(p.cast("int").alias(f"p{i}") for i, p in enumerate(places)), F.posexplode(data).alias("position", "r"))
    return good.select(*keys, "position", *(F.get("r", F.col(f"p{i}") - 1).alias(c) for i, c in enumerate(columns)))


def records_map(rows: DataFrame, keys: list[str], document: str, schema: str) -> DataFrame:
    """keys, name, fields of a JSON object whose values are records of one schema."""
    parsed = F.from_json(document, f"map<string,struct<{schema}>>")
    return rows.select(*keys, F.explode(parsed).alias("name", "r")).select(*keys, "name", "r.*")


def former_names(value: Column) -> Column:
    """struct<name, from, to> from a JSON record or plain text."""
    record = F.from_json(value, "name string, `from` string, `to` string")
    plain = F.struct(value.alias("name"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to"))
    return F.when(F.startswith(F.ltrim(value), F.lit("{")), record).otherwise(plain)


def overflow_references(rows: DataFrame, keys: list[str], names: str) -> tuple[DataFrame, DataFrame]:
    """(references, malformed) from an array of file names: a reference has a name of the expected form."""
    each = rows.select(*keys, F.posexplode_outer(names).alias("position", "name"))
    ok = F.coalesce(F.rlike("name", F.lit(r"^CIK[0-9]{10}-submissions-[0-9]{3}\.json$")), F.lit(False))
    return each.where(ok), each.where(~ok & F.col("position").isNotNull())
