"""Nested JSON objects: poll databases, indicator pages, boundary layers, packs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourclocks.functions.text import day_vintage, mode_class, period_end

NAMED = "map<string,struct<Name:string>>"
SURVEY = (
    "struct<Date:string,Survey_Period:struct<Date_Start:string,Date_End:string>,Surveyed_Persons:string,"
    "Parliament_ID:string,Institute_ID:string,Tasker_ID:string,Method_ID:string,Results:map<string,double>>"
)
POLL_DATABASE = (
    "Database struct<License:struct<Shortcut:string,Link:string>,Last_Update:string>, "
    f"Institutes {NAMED}, Taskers {NAMED}, Methods {NAMED}, Surveys map<string,{SURVEY}>"
)


def parse_poll_feed(
    raw: DataFrame,
    mapping: Mapping[str, str],
    unmapped: str,
    parliament_id: str,
    earliest: str | None = None,
    licence: str = "ODC-ODbL",
) -> DataFrame:
    """Polls of nested databases with mapped, normalised shares (contestant -> share).

    Names are looked up in the maps of the same object, and party results regroup inside the row,
    so parsing needs no shuffle. An object is parsed once: the generator that unpacks it keeps the optimizer from
    repeating the parse in filters. ``valid`` feeds the confidence gate; polls under another licence, with a date that
    does not parse, and objects without surveys stay as rows that are not valid.
    """
    own = [c for c in raw.columns if c != "content"]
    db = raw.select(*own, F.explode(F.array(F.from_json(F.col("content").cast("string"), POLL_DATABASE))).alias("_db"))
    polls = db.select(*own, "_db", F.explode_outer("_db.Surveys").alias("_id", "_s")).where(
        F.col("_s.Parliament_ID").isNull() | (F.col("_s.Parliament_ID") == parliament_id)
    )
    day = F.col("_s.Date").try_cast("date")
    if earliest is not None:
        polls = polls.where(F.coalesce(day >= F.lit(earliest).cast("date"), F.lit(True)))
    targets = sorted({*mapping.values(), unmapped})
    lookup = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    entries = F.map_entries("_s.Results")

    def held(target):
        mine = F.filter(entries, lambda e: F.coalesce(F.try_element_at(lookup, e["key"]), F.lit(unmapped)) == target)
        return F.aggregate(mine, F.lit(0.0), lambda acc, e: acc + e["value"])

    def name(field, identifier):
        return F.try_element_at(F.col(f"_db.{field}"), F.col(f"_s.{identifier}"))["Name"]

    sums = F.array(*[F.struct(F.lit(t).alias("key"), held(t).alias("value")) for t in targets])
    staged = polls.select(*own, "_db", "_id", "_s", F.explode(F.array(sums)).alias("_held"))
    staged = staged.withColumn("_total", F.aggregate("_held", F.lit(0.0), lambda a, e: a + e["value"]))
    shares = F.map_from_entries(F.transform("_held", lambda e: F.struct(e["key"], F.try_divide(e["value"], F.col("_total")))))
    clocks = day_vintage(day)
    out = staged.select(
        *[c for c in raw.columns if c != "content"],
        F.col("_id").alias("poll_key"),
        name("Institutes", "Institute_ID").alias("pollster"),
        name("Taskers", "Tasker_ID").alias("sponsor"),
        mode_class(name("Methods", "Method_ID")).alias("mode"),
        F.col("_s.Survey_Period.Date_Start").try_cast("date").alias("fieldwork_start"),
        F.col("_s.Survey_Period.Date_End").try_cast("date").alias("fieldwork_end"),
        clocks["released_at"].alias("released_at"),
        clocks["available_at"].alias("available_at"),
        F.col("_s.Surveyed_Persons").try_cast("int").alias("sample_size"),
        F.when(F.col("_total") > 0, shares).alias("shares"),
        F.col("_db.Database.License.Shortcut").eqNullSafe(F.lit(licence)).alias("_licensed"),
    )
    needed = ["pollster", "sponsor", "fieldwork_start", "fieldwork_end", "available_at", "sample_size", "shares"]
    valid = F.col("_licensed")
    for column in needed:
        valid = valid & F.col(column).isNotNull()
    return out.withColumn("valid", valid).drop("_licensed")


INDICATOR_ROWS = (
    "array<struct<country:struct<value:string>,countryiso3code:string,"
    "indicator:struct<id:string,value:string>,date:string,value:double,decimal:int>>"
)


def parse_indicator_pages(raw: DataFrame, source: str = "world_bank") -> DataFrame:
    """Canonical observations of ``[meta, rows]`` pages; incomplete rows drop out."""
    envelope = F.from_json(F.col("content").cast("string"), "array<string>")
    page = F.from_json(envelope[0], "page int, pages int, total int")
    staged = raw.withColumn("_e", envelope).where(F.size("_e") == 2)
    rows = staged.select(
        *[c for c in raw.columns if c != "content"],
        page["page"].alias("source_page"),
        F.explode(F.from_json(F.col("_e")[1], INDICATOR_ROWS)).alias("_r"),
    )
    observed = period_end(F.col("_r.date"))
    usable = (
        F.col("_r.value").isNotNull()
        & (F.length("_r.countryiso3code") > 0)
        & (F.length("_r.indicator.id") > 0)
        & observed.isNotNull()
    )
    return rows.where(usable).select(
        *[c for c in raw.columns if c != "content"],
        F.lower("_r.countryiso3code").alias("jurisdiction_id"),
        F.concat(F.lit(f"{source}:"), F.col("_r.indicator.id")).alias("metric"),
        observed.alias("observed_at"),
        F.col("_r.value").alias("value"),
        F.col("_r.country.value").alias("country_name"),
        "source_page",
    )


FEATURES = "array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_geojson(raw: DataFrame) -> DataFrame:
    """One row per feature with the rule it breaks, empty text when it is fine."""
    keep = [c for c in raw.columns if c != "content"]
    layer = raw.withColumn(
        "_l", F.from_json(F.col("content").cast("string"), f"type string, features {FEATURES}")
    )
    features = layer.select(*keep, F.col("_l.type").alias("_kind"), F.posexplode_outer("_l.features").alias("position", "_f"))
    geometry = F.col("_f.geometry")
    empty = geometry["coordinates"].isNull() | F.regexp_replace(geometry["coordinates"], r"[\[\]\s]", "").isin("")
    problem = (
        F.when(~F.col("_kind").eqNullSafe(F.lit("FeatureCollection")), "not_a_collection")
        .when(F.col("_f").isNull(), "no_features")
        .when(~F.coalesce(geometry["type"].isin("Polygon", "MultiPolygon"), F.lit(False)), "geometry_type")
        .when(empty, "empty_coordinates")
        .when(F.col("_f.properties").isNull(), "missing_properties")
        .otherwise("")
    )
    return features.select(
        *keep, "position", geometry["type"].alias("geometry_type"), F.col("_f.properties").alias("properties"), problem.alias("problem")
    )


PACK = (
    "jurisdiction struct<id:string,name:string,iso3:string,region:string,forecast_enabled:boolean>, "
    "source_adapters array<struct<source_id:string,status:string>>, "
    "rules map<string,string>, "
    "election struct<id:string,name:string,system:string,election_date:string,seats_total:int,majority:int,"
    "contestants:array<map<string,string>>,sources:array<struct<source_id:string,license:string,url:string>>>, "
    "model map<string,string>, "
    "reporting_units array<struct<id:string,name:string,parent_id:string,level:string,seats:int>>"
)


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON pack below a folder with its path and the hash of its bytes."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(folder)
    )
    pack = F.from_json(F.col("content").cast("string"), PACK)
    return files.select("path", F.sha2("content", 256).alias("sha256"), pack.alias("pack"))
