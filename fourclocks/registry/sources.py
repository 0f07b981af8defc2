"""Raw-object parsing and publishing over content derived from the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from fourclocks.bindings import Tables
from fourclocks.operators.asof import map_with_default
from fourclocks.registry import clock_text, day_text, query, rnd, with_ctes
from fourclocks.registry.ctes import POLLS, RESULTS
from fourclocks.session import shared_folder
from fourclocks.sources import calendars, documents, markup, sinks, snapshots, tabular


def raw_pages(t: Tables):
    day = F.lit("2024-01-15").cast("timestamp")
    docs = t.documents.select(F.col("source").alias("source_key"), F.col("text").alias("content"), "doc_id")
    pages = t.pages.select(F.lit("web").alias("source_key"), F.col("html").alias("content"), F.col("page_id").alias("doc_id"))
    return docs.unionByName(pages).withColumn("retrieved_at", day)


RAW = """
raw AS (SELECT source AS source_key, text AS content, doc_id FROM documents UNION ALL SELECT 'web', html, page_id FROM pages)"""


@query("src_snapshot_index", with_ctes("""
SELECT source_key, doc_id, sha256(content) AS sha256, CAST(strlen(content) AS INTEGER) AS byte_count,
       'raw/' || source_key || '/2024/01/15/' || substr(sha256(content), 1, 2) || '/' || sha256(content) AS object_key FROM raw""", RAW))
def _(t: Tables):
    return snapshots.snapshot_index(raw_pages(t), F.col("source_key")).select("source_key", "doc_id", "sha256", "byte_count", "object_key")


@query("src_snapshot_dedupe", with_ctes("""
SELECT DISTINCT source_key, sha256(content) AS sha256 FROM raw r
  WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = 'en' AND d.source = r.source_key AND d.text = r.content)""", RAW))
def _(t: Tables):
    indexed = snapshots.snapshot_index(raw_pages(t), F.col("source_key"))
    stored = t.documents.where(F.col("lang") == "en").select(F.col("source").alias("source_key"), F.sha2("text", 256).alias("sha256"))
    return snapshots.dedupe_snapshots(indexed, stored).select("source_key", "sha256")


@query("src_results_feed", """
SELECT event_id, CAST(user_id AS VARCHAR) AS unit_id, event_type AS contestant_id, CAST(floor(value) AS BIGINT) AS votes,
       json_extract_string(props, '$.k')::INTEGER / 100.0 AS reporting_fraction, strftime(ts, '%Y-%m-%d %H:%M:%S') AS reported_at, value > 100 AS is_certified,
       event_id % 11 <> 3 AS valid
FROM events WHERE event_id % 11 <> 5
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, FALSE, FALSE FROM events WHERE event_id % 11 = 5""")
def _(t: Tables):
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    fraction = F.get_json_object("props", "$.k").cast("int") / 100.0
    certified = F.when(F.col("value") > 100, "certified").otherwise("no")
    votes = F.floor("value").cast("string")
    stamp = F.when(F.col("event_id") % 11 == 3, F.regexp_replace(stamp, "[+]00:00$", "")).otherwise(stamp)  # no offset: refused
    row = F.struct(
        F.col("user_id").cast("string").alias("reporting_unit_id"), F.col("event_type").alias("contestant_id"),
        votes.alias("votes"), fraction.alias("reporting_fraction"), stamp.alias("reported_at"), certified.alias("is_certified"))
    listed = F.to_json(F.array(row))
    lines = F.concat(
        F.lit("reporting_unit_id,contestant_id,votes,reporting_fraction,reported_at,is_certified\n"),
        F.concat_ws(",", F.col("user_id").cast("string"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), votes, fraction.cast("string"), stamp, certified))
    kind = F.col("event_type")
    broken = F.when(kind.isin("click", "view"), F.lit('{"results":[{"reporting_unit_id"')).otherwise("reporting_unit_id,votes\n")
    raw = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 5, broken).when(kind == "click", listed).when(kind == "view", F.concat(F.lit('{"results":'), listed, F.lit("}"))).otherwise(lines).alias("content"),
        F.when(kind.isin("click", "view"), "json").otherwise("csv").alias("format"))
    stated = tabular.read_results(raw).join(t.events.select("event_id", F.col("ts").cast("timestamp").alias("_ts")), "event_id")
    # a stamp without an offset is no time; show the local text there, so that the row can be recognised
    shown = F.when(F.col("unit_id").isNotNull(), clock_text(F.coalesce("reported_at", "_ts")))
    return stated.withColumn("reported_at", shown).drop("_ts")


PARTIES = {"1": "alpha", "2": "nova"}


@query("src_poll_feed", with_ctes("""
SELECT poll_id, 'P' || poll_id AS poll_key, 'I' || pollster AS pollster, CASE mode WHEN 'live_phone' THEN 'live_phone' WHEN 'online' THEN 'online' ELSE 'mixed' END AS mode,
       CAST(fieldwork_end AS VARCHAR) AS fieldwork_end, strftime(timezone('Europe/Berlin', CAST(fieldwork_end + 1 AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS available_at,
       CAST(sample_size AS INTEGER) AS sample_size, round(qa / sample_size, 9) AS alpha, round(qn / sample_size, 9) AS nova, round(qr / sample_size, 9) AS other, poll_id % 13 <> 4 AS valid
FROM polls JOIN poll_amounts USING (poll_id, sample_size)""", POLLS))
def _(t: Tables):
    polls = t.poll_headers.join(t.poll_amounts, "poll_id")
    method = F.when(F.col("mode") == "live_phone", "Telefon").when(F.col("mode") == "online", "Online-Panel").when(F.col("mode") == "mixed", "Telefon und Online").otherwise("Brief")
    text = {c: F.col(c).cast("string") for c in ("poll_id", "pollster")}
    survey = F.struct(
        day_text("fieldwork_end").alias("Date"),
        F.struct(day_text("fieldwork_end").alias("Date_Start"), day_text("fieldwork_end").alias("Date_End")).alias("Survey_Period"),
        F.col("sample_size").cast("int").cast("string").alias("Surveyed_Persons"), F.lit("0").alias("Parliament_ID"),
        text["pollster"].alias("Institute_ID"), F.lit("1").alias("Tasker_ID"), F.lit("1").alias("Method_ID"),
        F.create_map(F.lit("1"), F.col("qA"), F.lit("2"), F.col("qN"), F.lit("9"), F.col("qR")).alias("Results"))
    database = F.struct(
        F.struct(F.struct(F.when(F.col("poll_id") % 13 == 4, "LINK-ONLY").otherwise("ODC-ODbL").alias("Shortcut"), F.lit("").alias("Link")).alias("License"), F.lit("2024-01-01T00:00:00+01:00").alias("Last_Update")).alias("Database"),
        F.create_map(text["pollster"], F.struct(F.concat(F.lit("I"), text["pollster"]).alias("Name"))).alias("Institutes"),
        F.create_map(F.lit("1"), F.struct(F.col("sponsor").alias("Name"))).alias("Taskers"),
        F.create_map(F.lit("1"), F.struct(method.alias("Name"))).alias("Methods"),
        F.create_map(F.concat(F.lit("P"), text["poll_id"]), survey).alias("Surveys"))
    raw = polls.select("poll_id", F.to_json(database).alias("content"))
    out = documents.parse_poll_feed(raw, PARTIES, "other", "0", "1990-01-01")
    share = {c: rnd(F.coalesce(F.try_element_at("shares", F.lit(c)), F.lit(0.0))).alias(c) for c in ("alpha", "nova", "other")}
    return out.select(
        "poll_id", "poll_key", "pollster", "mode", day_text("fieldwork_end").alias("fieldwork_end"),
        clock_text("available_at").alias("available_at"), "sample_size", *share.values(), "valid")


@query("src_poll_feed_mapping", with_ctes("""
SELECT poll_id, CASE contestant_id WHEN 'A' THEN 'alpha' WHEN 'N' THEN 'alpha' ELSE 'unmapped' END AS contestant, round(sum(share), 9) AS share
FROM poll_results GROUP BY 1, 2""", RESULTS))
def _(t: Tables):
    mapped = map_with_default(t.poll_results, "contestant_id", {"A": "alpha", "N": "alpha"}, "unmapped", "contestant")
    return mapped.groupBy("poll_id", "contestant").agg(rnd(F.sum("share")).alias("share"))


@query("src_indicator_pages", """
SELECT c_custkey, lower(c_mktsegment) AS jurisdiction_id, 'world_bank:BAL' AS metric, (1960 + c_nationkey) || '-12-31' AS observed_at, c_acctbal AS value
FROM customer WHERE c_acctbal >= 0""")
def _(t: Tables):
    row = F.struct(
        F.struct(F.col("c_name").alias("value")).alias("country"), F.col("c_mktsegment").alias("countryiso3code"),
        F.struct(F.lit("BAL").alias("id"), F.lit("Balance").alias("value")).alias("indicator"),
        (F.col("c_nationkey") + 1960).cast("string").alias("date"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("value"), F.lit(1).alias("decimal"))
    content = F.concat(F.lit('[{"page":1,"pages":1,"total":1},'), F.to_json(F.array(row)), F.lit("]"))
    out = documents.parse_indicator_pages(t.customer.select("c_custkey", content.alias("content")))
    return out.select("c_custkey", "jurisdiction_id", "metric", day_text("observed_at").alias("observed_at"), "value")


@query("src_inventory", """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS byte_count, md5(text) AS md5,
       CASE lang WHEN 'en' THEN 'events' WHEN 'fr' THEN 'mentions' ELSE 'gkg' END AS "table", TRUE AS bytes_match
FROM documents WHERE lang <> 'es'""")
def _(t: Tables):
    suffix = F.when(F.col("lang") == "en", ".export.CSV.zip").when(F.col("lang") == "fr", ".mentions.CSV.zip").otherwise(".gkg.csv.zip")
    url = F.concat(F.lit("https://files.example/"), F.col("source"), suffix)
    size = F.octet_length(F.col("text")).cast("string")
    line = F.when(F.col("lang") == "es", size).otherwise(F.concat_ws(" ", size, F.md5("text"), url))
    listed = tabular.parse_inventory(t.documents.select("doc_id", line.alias("line")))
    actual = t.documents.select("doc_id", F.octet_length("text").alias("actual"))
    return listed.join(actual, "doc_id").select(
        "doc_id", "byte_count", "md5", "table", (F.col("byte_count") == F.col("actual")).alias("bytes_match"))


@query("src_inventory_violations", """
SELECT source, n_chars % 40 AS batch, count(*) FILTER (lang = 'en') AS event_files FROM documents GROUP BY 1, 2 HAVING count(*) FILTER (lang = 'en') <> 1""")
def _(t: Tables):
    suffix = F.when(F.col("lang") == "en", ".export.CSV.zip").when(F.col("lang") == "fr", ".mentions.CSV.zip").otherwise(".gkg.csv.zip")
    line = F.concat_ws(" ", F.octet_length(F.col("text")).cast("string"), F.md5("text"), F.concat(F.lit("https://files.example/"), F.col("source"), suffix))
    listed = tabular.parse_inventory(t.documents.select("source", (F.col("n_chars") % 40).alias("batch"), line.alias("line")))
    return tabular.inventory_violations(listed, ["source", "batch"])


@query("src_sdmx_csv", """
SELECT c_custkey, lower(c_mktsegment) AS jurisdiction_id, 'prices:annual' AS metric, (1970 + c_nationkey) || '-12-31' AS observed_at, c_acctbal AS value, c_nationkey = 3 AS drifted
FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'""")
def _(t: Tables):
    value = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("")
    line = F.concat_ws(",", F.lit('"flow, one"'), F.lower("c_mktsegment"), F.when(F.col("c_nationkey") == 3, "Q").otherwise("A"),
        (F.col("c_nationkey") + 1970).cast("string"), value)
    content = F.concat(F.lit("DATAFLOW,REF_AREA,FREQ,TIME_PERIOD,OBS_VALUE\r\n"), line)
    areas = {a: a.lower() for a in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")}
    out = tabular.parse_sdmx_csv(t.customer.select("c_custkey", content.alias("content")), "REF_AREA", areas, "prices:annual", {"FREQ": "A"})
    return out.withColumn("observed_at", day_text("observed_at"))


@query("src_event_export", """
SELECT event_id, CAST(user_id AS VARCHAR) AS country, CASE WHEN event_type = 'view' THEN 0 ELSE k % 5 END AS event_class, CAST(k AS BIGINT) AS mentions, value AS tone, -value AS score
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type NOT IN ('signup', 'error')""")
def _(t: Tables):
    k = F.get_json_object("props", "$.k").cast("int")
    held = {
        29: F.when(F.col("event_type") == "view", "").otherwise((k % 5).cast("string")), 30: (-F.col("value")).cast("string"), 31: k.cast("string"),
        34: F.col("value").cast("string"), 53: F.when(F.col("event_type") == "error", "").otherwise(F.col("user_id").cast("string"))}
    width = [held.get(i, F.lit("x")) for i in range(61)]
    line = F.when(F.col("event_type") == "signup", F.concat_ws("\t", *width[:60])).otherwise(F.concat_ws("\t", *width))
    return tabular.parse_event_export(t.events.select("event_id", line.alias("line")))


CALENDAR = """
SELECT o_orderkey, 'e-' || o_orderkey AS election_id, 'Vote & count ' || o_orderkey AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS election_date,
       CASE o_orderstatus WHEN 'F' THEN 'held' ELSE 'scheduled' END AS status"""


def calendar_objects(t: Tables):
    key = F.col("o_orderkey").cast("string")
    ident, name = F.concat(F.lit("e-"), key), F.concat(F.lit("Vote & count "), key)
    status = F.when(F.col("o_orderstatus") == "F", "Held").otherwise("Scheduled")
    iso, compact, dotted = (F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy"))
    record = F.struct(ident.alias("id"), name.alias("name"), iso.alias("date"), status.alias("status"))
    ics = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), ident, F.lit("\r\nSUMMARY:Vote &\r\n  count "), key, F.lit("\r\nDTSTART;VALUE=DATE:"), compact,
        F.lit("\r\nSTATUS:"), status, F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    html = F.concat(
        F.lit("<table><tr><th>ID</th><th>Name</th><th>Date</th><th>Status</th></tr><tr class='x'><td>"), ident, F.lit("</td><td><b>Vote</b> &amp;\n count "), key,
        F.lit("</td><td>"), dotted, F.lit("</td><td>"), status, F.lit("</td></tr></table>"))
    csv = F.concat(F.lit("id,name,date,status\n"), F.concat_ws(",", ident, name, iso, status))
    kind = F.col("o_orderpriority")
    raw = t.orders.select(
        "o_orderkey",
        F.when(kind == "1-URGENT", F.to_json(F.array(record))).when(kind == "2-HIGH", F.concat(F.lit('{"elections":'), F.to_json(F.array(record)), F.lit("}")))
        .when(kind == "3-MEDIUM", ics).when(kind == "5-LOW", csv).otherwise(html).alias("content"),
        F.when(kind.isin("1-URGENT", "2-HIGH"), "json").when(kind == "3-MEDIUM", "ics").when(kind == "5-LOW", "csv").otherwise("html").alias("format"))
    return raw


@query("src_calendar_records", CALENDAR + " FROM orders")
def _(t: Tables):
    out = calendars.parse_calendar(calendar_objects(t)).where("valid")
    return out.select("o_orderkey", "election_id", "name", day_text("election_date").alias("election_date"), "status")


@query("src_calendar_unreadable", CALENDAR.replace("SELECT", "SELECT TRUE AS valid,") + """
FROM orders WHERE o_orderkey % 13 <> 5 UNION ALL SELECT FALSE, o_orderkey, '', '', '', '' FROM orders WHERE o_orderkey % 13 = 5""")
def _(t: Tables):
    # every thirteenth object is cut short, of no known format or of none
    turn, raw = F.col("o_orderkey") % 39, calendar_objects(t)
    broken = F.col("o_orderkey") % 13 == 5
    raw = raw.withColumns({
        "content": F.when(broken, F.substring("content", 1, 11)).otherwise(F.col("content")),
        "format": F.when(turn == 18, "docx").when(turn == 31, F.lit(None)).otherwise(F.col("format"))})
    out = calendars.parse_calendar(raw)
    shown = [F.when(F.col("valid"), c).otherwise("").alias(n) for n, c in (
        ("election_id", F.col("election_id")), ("name", F.col("name")), ("election_date", day_text("election_date")), ("status", F.col("status")))]
    return out.select("valid", "o_orderkey", *shown)


@query("src_markup_poll_tables", with_ctes("""
SELECT poll_id, CAST(ra + rb AS INTEGER) AS rows_used, round((ra * (a - 1) + rb * (a + 1)) / (100.0 * (ra + rb)), 9) AS first_share,
       round(1 - (ra * (a - 1) + rb * (a + 1)) / (100.0 * (ra + rb)), 9) AS second_share
FROM (SELECT poll_id, a, CASE WHEN a BETWEEN 26 AND 76 THEN 1 ELSE 0 END AS ra, CASE WHEN a BETWEEN 24 AND 74 THEN 1 ELSE 0 END AS rb
      FROM (SELECT poll_id, CAST(round(100 * sa) AS INTEGER) AS a FROM polls WHERE poll_id % 9 <> 2)) WHERE ra + rb > 0""", POLLS))
def _(t: Tables):
    a = F.round(F.col("shares")[0] * 100).cast("int")
    low, high, b, c = ((a - 1).cast("string"), (a + 1).cast("string"), (101 - a).cast("string"), (99 - a).cast("string"))
    text = F.concat(
        F.lit("Intro {{x}}\n{| class=\"wikitable\"\n! Date !! colspan=2 | Two-party vote\n|-\n! Firm !! "),
        F.when(F.col("poll_id") % 9 == 2, "Others").otherwise("Alpha"), F.lit(" !! Nova\n|-\n! 3 May 1998\n| Poll A || "),
        low, F.lit("% || '''"), b, F.lit("%'''\n|-\n! 1 May 1998\n| Poll B || "), high, F.lit("<ref>n 12</ref> || style | "), c,
        F.lit("\n|-\n! 1 April 1998\n| Gap || 12 || n/a\n|}\nEnd"))
    rules = markup.TableRules("(?i)two-party vote", r"\bAlpha\b", r"\bNova\b")
    # shares outside 25 to 75 and tables that do not name both parties are the operator's to refuse
    out = markup.extract_poll_rows(t.polls.select("poll_id", text.alias("content")), rules)
    return out.withColumns({"first_share": rnd("first_share"), "second_share": rnd("second_share")})


@query("src_markup_vectors", with_ctes("""
SELECT poll_id, CAST(ra + rb AS INTEGER) AS rows_used, round((ra * a + rb * (a + 1)) / (100.0 * ra + 101.0 * rb), 9) AS first_share, round(n * (ra + rb) / (100.0 * ra + 101.0 * rb), 9) AS second_share,
       round(r * (ra + rb) / (100.0 * ra + 101.0 * rb), 9) AS other_share
FROM (SELECT *, CAST(a < 100 AND n < 100 AND r < 100 AS INTEGER) AS ra, CAST(a + 1 < 100 AND n < 100 AND r < 100 AS INTEGER) AS rb
      FROM (SELECT *, 100 - a - n AS r FROM (SELECT poll_id, CAST(floor(100 * sa) AS INTEGER) AS a, CAST(floor(100 * sn) AS INTEGER) AS n FROM polls)))
WHERE ra + rb > 0""", POLLS))
def _(t: Tables):
    a, n = F.floor(F.col("shares")[0] * 100).cast("int"), F.floor(F.col("shares")[1] * 100).cast("int")
    text = [x.cast("string") for x in (a, n, 100 - a - n, a + 1)]
    body = F.concat(
        F.lit("Intro\n{| class=first\n| Other || 30 || 30 || 40\n|}\n== Campaign polling ==\n{{Box\n|a=1\n|}}\n{| class=x\n! Firm !! One !! Two !! Rest\n|-\n| Poll A || "), F.concat_ws(" || ", *text[:3]),
        F.lit("\n|\n{| class=inner\n| 2 || 20 || 20 || 60\n|-\n| 3 || 10 || 20 || 70\n|}\n|-\n| Poll B || "), F.concat_ws(" || ", text[3], *text[1:3]),
        F.lit("\n|-\n| Gap || 12 || n/a || 3\n|-\n| Sum || 40 || 40 || 40\n|}\n{| class=later\n| x || 30 || 30 || 40\n|}"))
    out = markup.extract_poll_vectors(t.polls.select("poll_id", body.alias("content")), markup.VectorRules(r"^==\s*Campaign polling\s*==\s*$", 1))
    return out.withColumns({c: rnd(c) for c in ("first_share", "second_share", "other_share")})


@query("src_geojson_layer", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'geometry_type' WHEN c_mktsegment = 'BUILDING' THEN 'empty_coordinates' WHEN c_mktsegment = 'MACHINERY' THEN 'no_features' ELSE '' END AS problem
FROM customer WHERE NOT (c_acctbal < 0 AND c_mktsegment = 'MACHINERY')
UNION ALL SELECT c_custkey, 'no_features' FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY'""")
def _(t: Tables):
    shape = F.when(F.col("c_acctbal") < 0, "Point").otherwise("Polygon")
    points = F.when(F.col("c_mktsegment") == "BUILDING", "[[]]").otherwise(F.concat(F.lit("[[[0,0],[1,"), F.col("c_nationkey").cast("string"), F.lit("],[0,0]]]")))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"'), F.col("c_custkey").cast("string"), F.lit('"},"geometry":{"type":"'), shape, F.lit('","coordinates":'), points, F.lit("}}"))
    body = F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(feature)
    content = F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}"))
    return documents.read_geojson(t.customer.select("c_custkey", content.alias("content"))).select("c_custkey", "problem")


def scratch(t: Tables, name: str) -> str:
    return os.path.join(shared_folder(t.spark), name, uuid.uuid4().hex)


@query("src_pack_scan", """
SELECT 'n' || n_nationkey AS jurisdiction_id, n_name AS name, sha256('{"jurisdiction":{"id":"n' || n_nationkey || '","name":"' || n_name || '"},"rules":{"engine":"fptp"}}' || chr(10)) AS sha256,
       'part=' || n_nationkey AS folder FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""")
def _(t: Tables):
    folder = scratch(t, "packs")
    present = t.nation.join(t.customer.select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    body = F.struct(
        F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")).alias("jurisdiction"),
        F.create_map(F.lit("engine"), F.lit("fptp")).alias("rules"))
    rows = present.select(F.col("n_nationkey").alias("part"), F.from_json(F.to_json(body), "jurisdiction struct<id:string,name:string>, rules map<string,string>").alias("b")).select("part", "b.*")
    rows.repartition("part").write.partitionBy("part").json(folder)
    packs = documents.read_packs(t.spark, folder)
    named = F.element_at(F.split("path", "/"), -2)
    return packs.select(F.col("pack.jurisdiction.id").alias("jurisdiction_id"), F.col("pack.jurisdiction.name").alias("name"), "sha256", named.alias("folder"))


@query("src_snapshot_collisions", """
SELECT 'k' || (doc_id % 50) AS object_key, count(DISTINCT text) AS contents FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1""")
def _(t: Tables):
    # a store that files texts under a key of its own instead of their digest
    stored = t.documents.select(F.concat(F.lit("k"), (F.col("doc_id") % 50).cast("string")).alias("object_key"), F.sha2("text", 256).alias("sha256"))
    return snapshots.snapshot_collisions(stored)


@query("src_elections_by_year", """
SELECT year, party, round(share, 9) AS share, round(lag(share) OVER (PARTITION BY party ORDER BY year), 9) AS fundamentals FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS party, count(*) / sum(count(*)) OVER (PARTITION BY year(o_orderdate)) AS share
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY year(o_orderdate), 2) QUALIFY lag(share) OVER (PARTITION BY party ORDER BY year) IS NOT NULL""")
def _(t: Tables):
    from fourclocks.operators.history import normalised_results

    votes = t.poll_headers.groupBy(F.year("fieldwork_end").alias("year"), F.col("sponsor").alias("party")).agg(F.count("*").alias("votes"))
    out = normalised_results(votes, ["year"], "party", "year").where(F.col("fundamentals").isNotNull())
    return out.select("year", "party", rnd("share").alias("share"), rnd("fundamentals").alias("fundamentals"))


@query("snk_partitioned_publish", """
SELECT c_nationkey AS election_id, count(*) AS records, count(DISTINCT o_orderkey) AS digests FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def _(t: Tables):
    folder = scratch(t, "published")
    forecasts = t.poll_headers.select("election_id", F.col("poll_id").alias("snapshot_id"), "mode", day_text("fieldwork_end").alias("as_of"))
    sinks.publish(forecasts, folder)
    sinks.publish(forecasts, folder)
    stored = t.spark.read.schema("election_id int, snapshot_id long, digest string, body string").json(folder)
    return stored.groupBy("election_id").agg(F.count("*").alias("records"), F.count_distinct("digest").alias("digests"))
