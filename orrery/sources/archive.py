"""ZIP members as rows, with every member's name and size checked before it is read."""

from __future__ import annotations

import io
import unicodedata
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Limits (fixed values): bytes of a member, of all members, ratio of expansion, members.
MEMBER_BYTES, TOTAL_BYTES, RATIO, MEMBERS = 512 << 20, 64 << 30, 2000, 2_000_000
SCHEMA = "archive string, member string, size long, problem string, content binary"


#: Encoded separators and device names that a member's name may not have (fixed values).
ENCODED = ("%2e", "%2f", "%5c", "%00")
DEVICES = ("con", "prn", "aux", "nul", *(f"{port}{n}" for port in ("com", "lpt") for n in range(1, 10)))


def canonical_name(name: str) -> tuple[str | None, str | None]:
    """(normal form, problem) of a member's name; a doubtful one is refused, never repaired.

    The normal form is NFC without `.` and empty components.
    """
    text = unicodedata.normalize("NFC", name)
    parts = [p for p in text.split("/") if p not in ("", ".")]
    folded = text.lower()
    refused = (
        (not text, "EMPTY_NAME"),
        (any(ord(c) < 32 for c in text), "CONTROL_CHARACTER"),
        (any(code in folded for code in ENCODED), "ENCODED_SEPARATOR"),
        ("\\" in text, "BACKSLASH"),
        (":" in text.split("/", 1)[0], "DRIVE_NAME"),
        (text.startswith("/"), "ABSOLUTE_NAME"),
        (".." in parts, "TRAVERSAL"),
        (not parts, "EMPTY_NAME"),
        (any(p[-1] in ". " for p in parts), "TRAILING_MARK"),
        (any(p.split(".", 1)[0].casefold() in DEVICES for p in parts), "DEVICE_NAME"),
    )
    problem = next((why for holds, why in refused if holds), None)
    return (None, problem) if problem else ("/".join(parts), None)


def members(data: bytes, suffix: str | None = None, names: list[str] | None = None) -> Iterator[tuple[str, int, str | None, bytes | None]]:
    """(name, size, problem, content) of each member that is asked for; a refused one has a problem and no content."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        yield "", 0, "NOT_AN_ARCHIVE", None
        return
    infos = [i for i in archive.infolist() if not i.is_dir()]
    if len(infos) > MEMBERS or sum(i.file_size for i in infos) > TOTAL_BYTES:
        yield "", 0, "ARCHIVE_TOO_LARGE", None
        return
    seen: set[str] = set()
    for i in infos:
        name, problem = canonical_name(i.filename)
        kind = (i.external_attr >> 16) & 0o170000
        if name is not None:
            if (suffix and not name.endswith(suffix)) or (names is not None and name not in names):
                continue
            if name.casefold() in seen:
                problem = "NAME_COLLISION"
            seen.add(name.casefold())
            if kind not in (0, 0o100000):
                problem = "SPECIAL_FILE"
            elif i.file_size > MEMBER_BYTES or i.file_size > RATIO * max(1, i.compress_size):
                problem = "EXPANSION"
        if problem:
            yield name or i.filename, i.file_size, problem, None
            continue
        content = archive.read(i)
        yield (name, len(content), None, content) if len(content) == i.file_size else (name, i.file_size, "SIZE_DIFFERS", None)


def scan(spark: SparkSession, path: str, suffix: str | None = None, names: list[str] | None = None) -> DataFrame:
    """One row a member of each archive under `path`; one archive is a task's unit, one member is held at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                for row in members(bytes(data), suffix, names):
                    yield pd.DataFrame([(p.rsplit("/", 1)[-1], *row)], columns=["archive", "member", "size", "problem", "content"])

    return files.mapInPandas(run, SCHEMA)
