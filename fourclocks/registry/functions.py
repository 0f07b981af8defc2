"""Scalar, array, map, JSON and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fourclocks.bindings import CONTESTANTS, POLL_CUTOFF, Tables, ts
from fourclocks.functions import shares as s
from fourclocks.functions import text as x
from fourclocks.operators.asof import map_with_default
from fourclocks.registry import clock_text, day_text, query, rnd, with_ctes
from fourclocks.registry.ctes import OBS, POLLS, RESULTS

K = len(CONTESTANTS)


@query("fn_content_hash", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|\\N') AS sha FROM orders")
def _(t: Tables):
    parts = [F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")]
    return t.orders.select("o_orderkey", x.content_hash(*parts, F.lit(None)).alias("sha"))


@query("fn_json_hash", """
SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"note":null,"status":"' || o_orderstatus || '"}') AS sha FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", x.json_hash(status=F.col("o_orderstatus"), customer=F.col("o_custkey"), note=F.lit(None).cast("string")).alias("sha"))


DIGEST = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url))"


@query("fn_uuid5", f"""
SELECT page_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab89ab89ab89ab', CAST('0x' || substr(d, 17, 1) AS INTEGER) + 1, 1)
       || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM (SELECT page_id, {DIGEST} AS d FROM pages)""")
def _(t: Tables):
    return t.pages.select("page_id", x.uuid5(F.col("url")).alias("id"))


@query("fn_normalise", with_ctes("""
SELECT poll_id, round(greatest(sa, 0.001) / (greatest(sa, 0.001) + greatest(sn, 0.001) + greatest(sr, 0.001)), 9) AS n0,
       round(greatest(sr, 0.001) / (greatest(sa, 0.001) + greatest(sn, 0.001) + greatest(sr, 0.001)), 9) AS n2 FROM polls""", POLLS))
def _(t: Tables):
    v = s.normalise_vector(s.entries("shares", K))
    return t.polls.select("poll_id", rnd(v[0]).alias("n0"), rnd(v[2]).alias("n2"))


@query("fn_blend", with_ctes("""
SELECT poll_id, round(m0 / (m0 + m1 + m2), 9) AS b0 FROM (
  SELECT poll_id, 0.3 * 0.5 + 0.7 * sa AS m0, 0.3 * 0.3 + 0.7 * sn AS m1, 0.3 * 0.1 + 0.7 * sr AS m2 FROM polls)""", POLLS))
def _(t: Tables):
    prior = [F.lit(v) for v in (0.5, 0.3, 0.1)]
    return t.polls.select("poll_id", rnd(s.blend(prior, s.entries("shares", K), F.lit(0.7))[0]).alias("b0"))


@query("fn_half_life", f"""
SELECT o_orderkey, round(exp(-ln(2) * abs(DATE '{POLL_CUTOFF[:10]}' - CAST(o_orderdate AS DATE)) / 21.0), 9) AS decay FROM orders""")
def _(t: Tables):
    age = F.abs(F.datediff(ts(POLL_CUTOFF).cast("date"), F.col("o_orderdate").cast("date")))
    return t.orders.select("o_orderkey", rnd(s.half_life(age, 21)).alias("decay"))


@query("fn_horizon_scale", """
SELECT event_id, round(least(1.6, greatest(0.75, pow(greatest(value, 7) / 90.0, 0.18))), 9) AS scale FROM events""")
def _(t: Tables):
    return t.events.select("event_id", rnd(s.horizon_scale(F.col("value"))).alias("scale"))


@query("fn_effective_volatility", with_ctes("""
SELECT poll_id, round(least(0.18, greatest(0.05 * (1 + sa), sqrt(greatest(sn * (1 - sn) / sample_size, 0)))), 9) AS volatility FROM polls""", POLLS))
def _(t: Tables):
    sa, sn = s.entries("shares", K)[:2]
    variance = sn * (1 - sn) / F.col("sample_size")
    return t.polls.select("poll_id", rnd(s.effective_volatility(F.lit(0.05), 1 + sa, variance)).alias("volatility"))


@query("fn_logit", with_ctes("""
SELECT poll_id, round(ln(c / (1 - c)), 9) AS logit FROM (SELECT *, least(greatest(sa, 0.01), 0.99) AS c FROM polls)""", POLLS))
def _(t: Tables):
    return t.polls.select("poll_id", rnd(s.logit(F.col("shares")[0])).alias("logit"))


@query("fn_sigmoid", with_ctes("SELECT poll_id, round(1 / (1 + exp(-(sa - sr))), 9) AS sigmoid FROM polls", POLLS))
def _(t: Tables):
    sa, _, sr = s.entries("shares", K)
    return t.polls.select("poll_id", rnd(s.sigmoid(sa - sr)).alias("sigmoid"))


@query("fn_entropy_bits", with_ctes("""
SELECT poll_id, round(CASE WHEN sa <= 0 OR sa >= 1 THEN 0 ELSE -(sa * log2(sa)) - (1 - sa) * log2(1 - sa) END, 9) AS entropy FROM polls""", POLLS))
def _(t: Tables):
    return t.polls.select("poll_id", rnd(s.entropy_bits(F.col("shares")[0])).alias("entropy"))


@query("fn_mc_se", with_ctes("""
SELECT poll_id, round(sqrt(sa * (1 - sa) / sample_size) * 100, 9) AS se, round(sn - sa, 9) AS width FROM polls""", POLLS))
def _(t: Tables):
    sa, sn, _ = s.entries("shares", K)
    return t.polls.select("poll_id", rnd(s.mc_se(sa, F.col("sample_size"))).alias("se"), rnd(s.interval_width(sa, sn)).alias("width"))


@query("fn_horizon_tolerance", """
SELECT event_id, CAST(greatest(2, least(30, ceil(floor(value) * 0.1))) AS INTEGER) AS tolerance FROM events""")
def _(t: Tables):
    return t.events.select("event_id", s.horizon_tolerance(F.floor("value").cast("int")).alias("tolerance"))


@query("fn_day_end_vintage", """
SELECT event_id, strftime(timezone('Europe/Berlin', CAST(d AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS observed_at,
       strftime(timezone('Europe/Berlin', CAST(d + 1 AS TIMESTAMP)) - INTERVAL 1 MICROSECOND, '%Y-%m-%d %H:%M:%S') AS released_at,
       strftime(timezone('Europe/Berlin', CAST(d + 1 AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS available_at
FROM (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t: Tables):
    clocks = x.day_vintage(F.col("o_orderdate").cast("date"))
    return t.orders.select(F.col("o_orderkey").alias("event_id"), *[clock_text(clocks[c]).alias(c) for c in ("observed_at", "released_at", "available_at")])


@query("fn_period_end", """
SELECT doc_id, CASE WHEN n_chars BETWEEN 1000 AND 9999 THEN n_chars || '-12-31' ELSE '' END AS period_end FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", F.coalesce(day_text(x.period_end(F.col("n_chars").cast("string"))), F.lit("")).alias("period_end"))


@query("fn_multi_format_date", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders""")
def _(t: Tables):
    def f(pattern):
        return F.date_format("o_orderdate", pattern)

    p = F.col("o_orderpriority")
    text = F.when(p == "1-URGENT", f("yyyyMMdd")).when(p == "2-HIGH", f("dd.MM.yyyy")).when(p == "5-LOW", f("MMM yyyy")).otherwise(f("yyyy-MM-dd"))
    parsed = x.parse_date(text, ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy"))
    return t.orders.select("o_orderkey", F.coalesce(day_text(parsed), F.lit("")).alias("day"))


@query("fn_mode_class", """
SELECT doc_id, CASE WHEN contains(m, 'telefon') AND NOT contains(m, 'online') THEN 'live_phone' WHEN contains(m, 'online') AND NOT contains(m, 'telefon') THEN 'online' ELSE 'mixed' END AS mode
FROM (SELECT doc_id, lower(CASE lang WHEN 'en' THEN 'Online ' WHEN 'fr' THEN 'TELEFON ' WHEN 'de' THEN 'Telefon+Online ' ELSE '' END || text) AS m FROM documents)""")
def _(t: Tables):
    lang = F.col("lang")
    prefix = F.when(lang == "en", "Online ").when(lang == "fr", "TELEFON ").when(lang == "de", "Telefon+Online ").otherwise("")
    return t.documents.select("doc_id", x.mode_class(F.concat(prefix, "text")).alias("mode"))


@query("fn_bool_text", """
SELECT event_id, event_type IN ('click', 'view') AS flag FROM events""")
def _(t: Tables):
    kind = F.col("event_type")
    text = F.when(kind == "click", " TRUE ").when(kind == "view", "Certified").when(kind == "error", "0").otherwise("no")
    return t.events.select("event_id", x.bool_text(text).alias("flag"))


@query("fn_tz_timestamp", """
SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events""")
def _(t: Tables):
    plain = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    text = F.when(kind == "click", plain).when(kind == "view", F.concat(plain, F.lit("+02:00"))).otherwise(F.concat(plain, F.lit("Z")))
    return t.events.select("event_id", F.coalesce(clock_text(x.tz_timestamp(text)), F.lit("")).alias("stamp"))


@query("fn_visible_text", r"""
SELECT page_id, sha256(v) AS sha, (CAST(contains(v, 'license') AS INTEGER) + CAST(contains(v, 'track(') AS INTEGER)) / 2.0 AS markers
FROM (SELECT page_id, trim(regexp_replace(replace(lower(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
      '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;?', '&', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')) AS v FROM pages)""")
def _(t: Tables):
    visible = t.pages.select("page_id", x.visible_text(F.col("html")).alias("v"))
    return visible.select("page_id", F.sha2("v", 256).alias("sha"), x.marker_share(F.col("v"), ["License", "track("]).alias("markers"))


@query("fn_cell_number", """
SELECT event_id, CASE event_type WHEN 'error' THEN -1.0 ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS number FROM events""")
def _(t: Tables):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    cell = (
        F.when(kind == "click", F.concat(F.lit("style=x | '''"), k, F.lit("'''")))
        .when(kind == "view", F.concat(F.lit("7 of "), k, F.lit(" %<ref>99</ref>")))
        .when(kind == "error", F.concat(F.lit("n/a {{cite 12}}<!-- 5 -->")))
        .otherwise(k)
    )
    return t.events.select("event_id", F.coalesce(x.cell_number(cell), F.lit(-1.0)).alias("number"))


@query("fn_strip_suffix", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'v1' ELSE 'v1:other' END AS version FROM orders")
def _(t: Tables):
    ident = F.concat(F.lit("v1:"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("other"))
    return t.orders.select("o_orderkey", x.strip_suffix(ident, F.col("o_orderpriority")).alias("version"))


@query("fn_double_centre", with_ctes("""
SELECT poll_id, round(c00 - (c00 + c01) / 2 - (c00 + c01) / 2 + (c00 + c01 + c01 + c11) / 4, 12) + 0.0 AS d00, round(c01 - (c00 + c01) / 2 - (c01 + c11) / 2 + (c00 + c01 + c01 + c11) / 4, 12) + 0.0 AS d01
FROM (SELECT poll_id, sa * sa AS c00, sa * sn AS c01, sn * sr AS c11 FROM polls)""", POLLS))
def _(t: Tables):
    sa, sn, sr = s.entries("shares", K)
    d = s.double_centre([[sa * sa, sa * sn], [sa * sn, sn * sr]])
    return t.polls.select("poll_id", (rnd(d[0][0], 12) + 0.0).alias("d00"), (rnd(d[0][1], 12) + 0.0).alias("d01"))


@query("fn_map_regroup", with_ctes("""
SELECT poll_id, string_agg(c || '=' || n, ',' ORDER BY c) AS shares FROM (
  SELECT poll_id, CASE contestant_id WHEN 'R' THEN 'red' ELSE 'blue' END AS c, CAST(round(sum(share) * 1000) AS INTEGER) AS n FROM poll_results GROUP BY 1, 2) GROUP BY 1""", RESULTS))
def _(t: Tables):
    mapped = map_with_default(t.poll_results, "contestant_id", {"R": "red"}, "blue", "c")
    sums = mapped.groupBy("poll_id", "c").agg(F.sum("share").alias("v"))
    held = sums.groupBy("poll_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "v")))).alias("m"))
    text = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 1000).cast("int").cast("string")))
    return held.select("poll_id", F.array_join(text, ",").alias("shares"))


@query("fn_days_away", f"""
SELECT o_orderkey, CAST(greatest(ceil((epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) - epoch(TIMESTAMP '{POLL_CUTOFF[:10]} 06:00:00')) / 86400.0), 0) AS INTEGER) AS days FROM orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", x.days_away(F.col("o_orderdate").cast("date"), ts(f"{POLL_CUTOFF[:10]} 06:00:00")).alias("days"))


@query("fn_missing_drivers", """
SELECT event_id, concat_ws('; ', CASE WHEN value < 50 THEN 'spend' END, CASE WHEN event_type = 'click' THEN 'Source-vintage polling and fundamentals' WHEN event_type = 'view' THEN 'Macro: debt' END,
       CASE WHEN event_type = 'click' OR floor(value) > 45 THEN 'Source-vintage polling' END,
       CASE WHEN event_type IN ('click', 'view', 'error') OR floor(value) > 45 THEN 'Validated historical release-vintage backtest; Subnational model' END) AS gaps FROM events""")
def _(t: Tables):
    kind = F.col("event_type")
    drivers = F.array(F.struct(F.lit("spend").alias("label"), (F.col("value") / 250).alias("confidence")))
    macro = F.when(kind == "click", F.lit(None)).when(kind == "view", F.array(F.lit("debt"))).otherwise(F.array().cast("array<string>"))
    grade = F.when(kind == "error", "D").otherwise("B")
    gaps = x.missing_drivers(drivers, macro.cast("array<string>"), F.floor("value").cast("int"), grade)
    return t.events.select("event_id", F.array_join(gaps, "; ").alias("gaps"))


@query("fn_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t: Tables):
    return t.events.select("event_id", x.json_fields(F.col("props"), "k int")["k"].alias("k"))
