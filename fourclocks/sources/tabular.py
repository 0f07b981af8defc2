"""Row feeds inside raw objects: JSON lists, CSV, SDMX-CSV, inventories, event exports.

Every parser is a projection over a table of raw objects (one row per object, ``content`` text),
so many objects parse in parallel and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.functions.text import bool_text, period_end, tz_timestamp

# One record (a quoted field may hold line breaks) and one field after its comma; possessive, so time is linear.
CSV_RECORD = r'(?:[^"\n]++|"(?:[^"]++|"")*+"?+)++'
CSV_FIELD = r',("(?:[^"]++|"")*+"|[^,]*+)'
RECORD = "map<string,string>"


def clean(content: Column) -> Column:
    """Text without a byte-order mark and with plain line ends."""
    text = F.regexp_replace(content.cast("string"), r"^\uFEFF", "")
    return F.regexp_replace(text, "\r\n", "\n")


def json_records(content: Column, list_field: str) -> Column:
    """Records of a bare JSON list, or of the list under a named field of an object."""
    bare = F.from_json(content, f"array<{RECORD}>")
    nested = F.from_json(F.from_json(content, RECORD)[list_field], f"array<{RECORD}>")
    return F.when(F.ltrim(content).startswith("["), bare).otherwise(nested)


def _csv_fields(line: Column) -> Column:
    """Fields of one CSV record; quoted fields may hold commas, line breaks and doubled quotes."""

    def unquote(field):
        inner = F.substring(field, F.lit(2), F.length(field) - 2)
        return F.when(field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(field)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CSV_FIELD), F.lit(1)), unquote)


def csv_records(df: DataFrame, content: str, name: str = "record") -> DataFrame:
    """One map per data record of CSV text with a header; short records leave their last fields out.

    Of equal header names the last one holds. Content without a data record stays as one row with a null map.
    """
    lines = F.filter(F.regexp_extract_all(F.col(content), F.lit(CSV_RECORD), F.lit(0)), lambda line: F.trim(line) != "")
    rows = F.transform(lines, _csv_fields)
    header, body = F.col("_rows")[0], F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))

    def record(row):
        cells = F.transform(F.slice(header, F.lit(1), F.least(F.size(header), F.size(row))), lambda key, i: F.struct(key.alias("key"), row[i].alias("value"), i.alias("at")))
        names = cells["key"]
        return F.map_from_entries(
            F.transform(F.filter(cells, lambda c: F.array_position(F.reverse(names), c["key"]) == F.size(names) - c["at"]), lambda c: F.struct(c["key"], c["value"]))
        )

    return df.withColumn("_rows", rows).withColumn(name, F.explode_outer(F.transform(body, record))).drop("_rows")


def records(raw: DataFrame, list_field: str = "results") -> DataFrame:
    """``record`` maps of raw objects whose ``format`` column says json or csv; an unreadable object, one of another format or
    of none keeps one null record."""
    body = raw.withColumn("content", clean(F.col("content")))
    from_json = body.where(F.col("format") == "json").withColumn(
        "record", F.explode_outer(json_records(F.col("content"), list_field))
    )
    known = F.coalesce(F.col("format").isin("json", "csv"), F.lit(False))
    other = body.where(~known).withColumn("record", F.lit(None).cast("map<string,string>"))
    return from_json.unionByName(csv_records(body.where(F.col("format") == "csv"), "content")).unionByName(other)


@dataclass(frozen=True)
class ResultFields:
    unit: str = "reporting_unit_id"
    contestant: str = "contestant_id"
    votes: str = "votes"
    fraction: str = "reporting_fraction"
    reported_at: str = "reported_at"
    certified: str = "is_certified"
    list_field: str = "results"


def read_results(raw: DataFrame, fields: ResultFields = ResultFields()) -> DataFrame:
    """Result rows with a ``valid`` flag; malformed rows stay visible for the confidence gate."""
    r = records(raw, fields.list_field)

    def at(name):
        return F.col("record")[name]

    fraction = at(fields.fraction).try_cast("double")
    parsed = r.select(
        *[c for c in raw.columns if c not in ("content", "format")],
        F.trim(at(fields.unit)).alias("unit_id"),
        F.trim(at(fields.contestant)).alias("contestant_id"),
        at(fields.votes).try_cast("long").alias("votes"),
        fraction.alias("reporting_fraction"),
        tz_timestamp(at(fields.reported_at)).alias("reported_at"),
        F.coalesce(bool_text(at(fields.certified)), F.lit(False)).alias("is_certified"),
    )
    valid = (
        (F.length("unit_id") > 0)
        & (F.length("contestant_id") > 0)
        & (F.col("votes") >= 0)
        & F.col("reporting_fraction").between(0, 1)
        & F.col("reported_at").isNotNull()
    )
    return parsed.withColumn("valid", F.coalesce(valid, F.lit(False)))


def parse_sdmx_csv(
    raw: DataFrame, geo_field: str, areas: Mapping[str, str], metric: str, contract: Mapping[str, str]
) -> DataFrame:
    """Observations of SDMX-CSV objects; ``drifted`` marks kept rows that break the contract."""
    rows = csv_records(raw.withColumn("content", clean(F.col("content"))), "content")
    lookup = F.create_map(*[F.lit(x) for pair in areas.items() for x in pair])
    jurisdiction = F.try_element_at(lookup, F.upper(F.col("record")[geo_field]))
    value = F.col("record")["OBS_VALUE"].try_cast("double")
    observed = period_end(F.col("record")["TIME_PERIOD"])
    drifted = F.lit(False)
    for name, wanted in contract.items():
        drifted = drifted | ~F.col("record")[name].eqNullSafe(F.lit(wanted))
    return rows.select(
        *[c for c in raw.columns if c != "content"],
        jurisdiction.alias("jurisdiction_id"),
        F.lit(metric).alias("metric"),
        observed.alias("observed_at"),
        value.alias("value"),
        drifted.alias("drifted"),
    ).where(F.col("jurisdiction_id").isNotNull() & F.col("observed_at").isNotNull() & F.col("value").isNotNull())


def parse_inventory(lines: DataFrame, line: str = "line") -> DataFrame:
    """``bytes md5 url`` lines to typed rows with the table named by the URL."""
    parts = F.split(F.trim(F.col(line)), r"\s+")
    url = F.col("_p")[2]
    table = F.when(url.contains(".export."), "events").when(url.contains(".mentions."), "mentions").otherwise("gkg")
    return (
        lines.withColumn("_p", parts)
        .where(F.size("_p") == 3)
        .select(
            *[c for c in lines.columns if c != line],
            F.col("_p")[0].try_cast("long").alias("byte_count"),
            F.col("_p")[1].alias("md5"),
            url.alias("url"),
            table.alias("table"),
        )
    )


def inventory_violations(listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inventories that do not list exactly one events file, with the number they list; must be empty to go on."""
    counted = listed.groupBy(*keys).agg(F.count_if(F.col("table") == "events").alias("event_files"))
    return counted.where(F.col("event_files") != 1)


# 0-based positions in the 61-column event export.
EXPORT_COLUMNS = 61
EXPORT_POSITIONS = {"event_class": 29, "score": 30, "mentions": 31, "tone": 34, "country": 53}


def parse_event_export(lines: DataFrame, line: str = "line") -> DataFrame:
    """Tab-separated events with a country; blank numbers count as zero."""
    fields = F.split(F.col(line), "\t", -1)
    whole = lines.withColumn("_f", fields).where(F.size("_f") >= EXPORT_COLUMNS)

    def number(name, kind):
        return F.coalesce(F.col("_f")[EXPORT_POSITIONS[name]].try_cast(kind), F.lit(0).cast(kind)).alias(name)

    return whole.where(F.col("_f")[EXPORT_POSITIONS["country"]] != "").select(
        *[c for c in lines.columns if c != line],
        F.col("_f")[EXPORT_POSITIONS["country"]].alias("country"),
        number("event_class", "int"),
        number("mentions", "long"),
        number("tone", "double"),
        number("score", "double"),
    )
