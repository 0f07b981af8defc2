"""Election calendars in JSON, CSV, ICS or HTML tables, as one canonical record table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.functions.text import collapse, decode_references, parse_date
from fourclocks.sources.tabular import clean, csv_records, json_records

DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "dd/MM/yyyy")


@dataclass(frozen=True)
class CalendarFields:
    id: str = "id"
    name: str = "name"
    date: str = "date"
    status: str = "status"
    list_field: str = "elections"
    formats: Sequence[str] = DATE_FORMATS


def _ics_field(event: Column, name: str) -> Column:
    return F.regexp_extract(event, rf"(?im)^{name}(?:;[^:\n]*)?:(.*)$", 1)


def ics_records(content: Column) -> Column:
    """Unfolded VEVENT blocks as maps."""
    unfolded = F.regexp_replace(content, r"\n[ \t]", "")
    events = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)\nEND:VEVENT"), 1)

    def record(event):
        status = F.lower(_ics_field(event, "STATUS"))
        return F.create_map(
            F.lit("id"), _ics_field(event, "UID"),
            F.lit("name"), _ics_field(event, "SUMMARY"),
            F.lit("date"), F.substring(_ics_field(event, "DTSTART"), 1, 8),
            F.lit("status"), F.when(status == "", "scheduled").otherwise(status),
        )

    return F.transform(events, record)


def _cell_text(cell: Column) -> Column:
    return collapse(decode_references(F.regexp_replace(cell, r"<[^>]+>", "")))


def html_records(content: Column) -> Column:
    """Rows of the tables of a page as maps keyed by the first row."""
    rows = F.regexp_extract_all(content, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(
        rows,
        lambda row: F.transform(
            F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), _cell_text
        ),
    )
    header = F.transform(cells[0], lambda h: F.lower(F.trim(h)))
    body = F.filter(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.size(r) > 0)

    # of a repeated header the last column counts, as in CSV
    places = F.transform(F.array_distinct(header), lambda name: F.struct(name.alias("name"), (F.size(header) - F.array_position(F.reverse(header), name) + 1).cast("int").alias("at")))

    def record(row):
        there = F.filter(places, lambda p: p["at"] <= F.size(row))
        return F.map_from_arrays(there["name"], F.transform(there["at"], lambda at: F.element_at(row, at)))

    return F.when(F.size(rows) >= 2, F.transform(body, record))


def parse_calendar(raw: DataFrame, fields: CalendarFields = CalendarFields()) -> DataFrame:
    """Calendar records of raw objects (``format``: json, csv, ics, html) with a ``valid`` flag.

    An object that cannot be read, holds no records or has another format keeps one row, which is not valid.
    """
    body = raw.withColumn("content", clean(F.col("content")))
    kind = F.col("format")
    listed = (
        F.when(kind == "json", json_records(F.col("content"), fields.list_field))
        .when(kind == "ics", ics_records(F.col("content")))
        .when(kind == "html", html_records(F.col("content")))
    )
    exploded = body.where(~kind.eqNullSafe(F.lit("csv"))).withColumn("record", F.explode_outer(listed))
    rows = exploded.unionByName(csv_records(body.where(kind == "csv"), "content"))

    def at(name):
        return F.trim(F.col("record")[name])

    out = rows.select(
        *[c for c in raw.columns if c != "content"],
        at(fields.id).alias("election_id"),
        at(fields.name).alias("name"),
        parse_date(F.col("record")[fields.date], fields.formats).alias("election_date"),
        F.lower(F.coalesce(at(fields.status), F.lit("scheduled"))).alias("status"),
    )
    valid = (F.length("election_id") > 0) & (F.length("name") > 0) & F.col("election_date").isNotNull()
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))
