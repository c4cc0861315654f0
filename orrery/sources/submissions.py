"""The nested document of one registrant: its record, its filings, its references to further files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.functions.scalars import normalise_registrant
from orrery.sources.json_arrays import overflow_references, region_verdict, transpose


def kind(value: Column) -> Column:
    """null, string, number, boolean, array or object of a variant; null where there is none."""
    name = F.schema_of_variant(value)
    return F.when(value.isNull(), None).when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(F.startswith(name, F.lit("ARRAY")), "array").when(F.startswith(name, F.lit("OBJECT")), "object").otherwise("number")


def drift_events(rows: DataFrame, key: str, document: str, required: dict[str, str], optional: list[str] = (), arrays: list[str] = ()) -> DataFrame:
    """key, event, field: one row for each way in which a JSON object departs from its contract.

    `required` names each field's kind. Events: required_field_missing, unexpected_null, type_changed
    (required fields only), malformed_nested_array (an array field that holds anything else),
    unknown_field_retained, and malformed_document, of a text that is no JSON object.
    """
    doc, keys = F.try_parse_json(document), F.json_object_keys(document)
    made = rows.select(key, F.when(keys.isNotNull(), doc).alias("v"), keys.alias("k"))
    at = lambda f: kind(F.try_variant_get("v", f'$["{f}"]', "variant"))
    event = lambda test, name, field: F.when(test, F.struct(F.lit(name).alias("event"), F.lit(field).alias("field")))
    has = lambda f: F.array_contains("k", f)
    found = [event(F.col("k").isNull(), "malformed_document", "")]
    for f, want in required.items():
        found += [event(~has(f), "required_field_missing", f), event(has(f) & (at(f) == "null"), "unexpected_null", f), event(has(f) & ~at(f).isin("null", want), "type_changed", f)]
    found += [event(has(f) & (at(f) != "array"), "malformed_nested_array", f) for f in arrays]
    known = F.array(*map(F.lit, [*required, *optional, *arrays]))
    unknown = F.transform(F.coalesce(F.array_except("k", known), F.array().cast("array<string>")), lambda f: F.struct(F.lit("unknown_field_retained").alias("event"), f.alias("field")))
    return made.select(key, F.explode(F.concat(F.array_compact(F.array(*found)), unknown)).alias("e")).select(key, "e.event", "e.field")


def submissions(rows: DataFrame, key: str, document: str, arrays: list[str]) -> dict[str, DataFrame]:
    """registrants, filings, references, regions and quarantine of documents held as JSON text, one a row.

    A document that is no object, lacks `cik`, `name` or `filings`, has no usable registrant number or an
    empty name goes to quarantine whole and gives no record. Of the others, `filings.recent` gives one row
    a position of its parallel arrays; arrays of unequal length, and references of an unexpected form, go to
    quarantine alone and leave the rest of the document standing. Regions state whether a part is missing,
    malformed, empty (a true zero) or valid.
    """
    inner = ", ".join(f"`{a}`: array<string>" for a in arrays)
    shape = f"cik string, name string, filings struct<recent: struct<{inner}>, files: array<struct<name: string, filingCount: int>>>"
    events = drift_events(rows, key, document, {"name": "string", "filings": "object"})
    wrong = events.where("event <> 'unknown_field_retained'").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "event", "field"))), "; ").alias("reason"))  # five at most
    read = rows.join(wrong, key, "left").select(key, document, "reason", F.from_json(document, shape).alias("d")).withColumn("cik", normalise_registrant(F.col("d.cik")))
    empty = F.coalesce(F.trim("d.name"), F.lit("")) == ""
    read = read.withColumn("reason", F.coalesce("reason", F.when(F.col("cik").isNull(), "unusable:cik").when(empty, "empty:name")))
    good = read.where("reason IS NULL")
    blocks = good.where("d.filings.recent IS NOT NULL").select(key, "cik", *(F.col(f"d.filings.recent.{a}").alias(a) for a in arrays))
    filings, uneven = transpose(blocks, [key, "cik"], arrays)
    references, odd = overflow_references(good.select(key, "cik", F.col("d.filings.files.name").alias("names")), [key, "cik"], "names")
    bad = read.where("reason IS NOT NULL").select(key, F.lit("document").alias("part"), "reason")
    bad = bad.unionByName(uneven.select(key, F.lit("filings").alias("part"), F.concat_ws(":", "reason", "sizes").alias("reason")))
    bad = bad.unionByName(odd.select(key, F.lit("reference").alias("part"), F.coalesce("name", F.lit("no name")).alias("reason")))
    return {"registrants": good.select(key, "cik", F.trim("d.name").alias("name")), "filings": filings, "references": references, "regions": rows.select(key, region_verdict(F.col(document), "$.filings.recent").alias("recent")), "quarantine": bad}
