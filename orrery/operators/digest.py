"""Order-independent digests of tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F

UNIT, RECORD, NULL = "\x1f", "\x1e", "\x00null"


def cell(df: DataFrame, name: str) -> Column:
    """Type-directed text of a cell: booleans as 1 and 0, doubles rounded to 12 digits, dates in ISO form, bytes as hexadecimal."""
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if kind == "boolean":
        out = c.cast("int").cast("string")
    elif kind in ("double", "float"):
        out = F.round(c.cast("double"), 12).cast("string")
    elif kind == "binary":
        out = F.lower(F.hex(c))
    elif kind == "timestamp":
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(NULL))


def row_text(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(UNIT, *(cell(df, c) for c in columns))


def table_digest(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(table, n_rows, digest) of a small table in the single-string form: name, header and sorted rows, SHA-256.

    All rows meet in one string, so it is for tables known to be small; `large_digest` isn't.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_list(row_text(df, columns))), RECORD).alias("rows"))
    body = F.concat(F.lit(name + RECORD + UNIT.join(columns)), F.when(F.col("n_rows") > 0, F.concat(F.lit(RECORD), F.col("rows"))).otherwise(F.lit("")))
    return rows.select(F.lit(name).alias("table"), "n_rows", F.sha2(body, 256).alias("digest"))


def large_digest(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(table, n_rows, digest) of a table of any size: sums of the rows' SHA-256 words, a partial aggregate without order.

    Not equal to the single-string form; repeated rows count.
    """
    h = F.sha2(row_text(df, columns), 256)
    words = [F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)") for k in range(5)]
    out = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"w{k}") for k, w in enumerate(words)))
    return out.select(F.lit(name).alias("table"), "n_rows", F.sha2(F.concat_ws("|", F.lit(name), F.lit(UNIT.join(columns)), F.col("n_rows").cast("string"), *(f"w{k}" for k in range(5))), 256).alias("digest"))


def release_digest(tables: DataFrame) -> str:
    """SHA-256 of the JSON list of (rows, sha256, table) by table; one row a table on the driver."""
    rows = sorted(tables.collect(), key=lambda r: r["table"])
    text = json.dumps([{"rows": r["n_rows"], "sha256": r["digest"], "table": r["table"]} for r in rows], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_json(document: object) -> str:
    return json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def manifest(tables: DataFrame, gates: DataFrame, **fields: str) -> str:
    """A release's manifest as canonical JSON."""
    verdicts = {r["gate"]: r["verdict"] for r in gates.collect()}
    return canonical_json({**fields, "release_digest": release_digest(tables), "gates": verdicts, "tables": {r["table"]: {"rows": r["n_rows"], "sha256": r["digest"]} for r in tables.collect()}})


def record_hash(payload: Column, unknown: Column) -> Column:
    """SHA-256 of the canonical JSON of a payload (map<string, string>) with the sorted paths of its unknown fields.

    Keys are sorted, separators compact and nulls kept, so an unknown field in a part that isn't copied
    still changes the hash. Control characters above U+0009 are escaped with upper-case digits.
    """
    ordered = F.map_from_entries(F.array_sort(F.map_entries(payload)))
    envelope = F.struct(ordered.alias("payload"), F.array_sort(unknown).alias("unknown_field_paths"))
    return F.sha2(F.to_json(envelope, {"ignoreNullFields": "false"}), 256)
