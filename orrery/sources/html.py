"""HTML sources, read with the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE = re.compile(rf"\b({'|'.join(MONTHS)})\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b", re.IGNORECASE)


class Reader(HTMLParser):
    """Title, list items, links and tables of one page; scripts and styles have no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.items, self.links, self.tables = "", [], [], []
        self.in_title, self.skip, self.item, self.row, self.cell = False, 0, [], None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "li":
            self.item.append([])
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.end_cell()
            self.row = []
            self.tables[-1].append(self.row)
        elif tag in ("td", "th") and self.row is not None:
            self.end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "li" and self.item:
            self.items.append(" ".join("".join(self.item.pop()).split()))
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag in ("tr", "table"):
            self.end_cell()
            self.row = None

    def end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row.append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
        for part in self.item:
            part.append(data)
        if self.cell is not None:
            self.cell.append(data)


def read(html: str | None) -> Reader:
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    return reader


SCHEMA = "title string, items array<string>, links array<string>, tables array<array<array<string>>>"
ARROW = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.list_(pa.list_(pa.string()))))


def extract(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id_col, title, items, links, tables of each page; a null page is empty."""
    one = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [read(h) for h in part.column(1).to_pylist()]
                values = ([" ".join(r.title.split()) for r in found], [r.items for r in found], [r.links for r in found], [r.tables for r in found])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(values, ARROW, strict=True))], ["id", "title", "items", "links", "tables"])

    return one.mapInArrow(run, f"id {one.schema['id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("id", id_col)


def code_table(extracted: DataFrame, id_col: str, labels: tuple[str, ...] = ("code", "office", "title")) -> DataFrame:
    """id_col, labels of table rows whose code cell is four digits; columns are found by the header's labels."""
    rows = extracted.select(id_col, F.explode("tables").alias("t")).withColumn("header", F.transform(F.element_at("t", 1), lambda c: F.lower(c)))
    place = [F.array_position("header", label) for label in labels]
    ok = place[0] > 0
    out = rows.where(ok).select(id_col, *(p.cast("int").alias(f"p{i}") for i, p in enumerate(place)), F.explode("t").alias("r"))
    found = out.select(id_col, *(F.when(F.col(f"p{i}") > 0, F.get("r", F.col(f"p{i}") - 1)).alias(label) for i, label in enumerate(labels)))
    return found.where(F.rlike(labels[0], F.lit("^[0-9]{4}$")))


def calendar_days(extracted: DataFrame, id_col: str) -> DataFrame:
    """id_col, day, name: dates in list items and table rows that speak of a holiday or closing; dates elsewhere assert nothing."""
    lines = F.concat("items", F.flatten(F.transform("tables", lambda t: F.transform(t, lambda r: F.array_join(r, " ")))))
    each = extracted.select(id_col, F.explode(lines).alias("line")).where(F.rlike("line", F.lit("(?i)holiday|closed|observed|federal")))
    pattern = rf"(?i)\b({'|'.join(MONTHS)})\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract("line", pattern, 1)))
    parts = (F.regexp_extract("line", pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract("line", pattern, 2), 2, "0"))
    day = F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
    return each.select(id_col, day.alias("day"), F.trim(F.regexp_replace("line", pattern, "")).alias("name")).where("day IS NOT NULL")


def announcement(extracted: DataFrame, id_col: str, day: str) -> DataFrame:
    """id_col, claim (closed, open, silent) of a page about a day given as text, by the language beside it."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.array_join("items", " ")))
    about = F.contains(text, F.lit(day.lower()))
    closed, open_ = F.rlike(text, F.lit(r"\b(?:will be|is|are) closed\b|\bnot (?:be )?operating\b")), F.rlike(text, F.lit(r"\b(?:will|is|are) (?:be )?(?:open|operating normally)\b"))
    return extracted.select(id_col, F.when(about & closed & ~open_, "closed").when(about & open_ & ~closed, "open").otherwise("silent").alias("claim"))
