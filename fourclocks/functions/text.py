"""Identifier, date and text helpers as Column expressions."""

from __future__ import annotations

import html.entities
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
# Built by rule: all named character references, those that may stand without a semicolon, and the old Windows bytes.
NAMED = json.dumps({f"&{name}": char for name, char in html.entities.html5.items()})
BARE_NAME = "^&(?:" + "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
WINDOWS = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]
REFERENCE = r"(?s)(&#(?:\d+|[xX][0-9A-Fa-f]+);?|&[A-Za-z][A-Za-z0-9]{0,31};?|[^&]+|&)"
# Built by rule: lower-case characters that full case folding changes further, to one character or to several.
FOLDS = {c: c.casefold() for c in map(chr, range(0x10000)) if c.isalpha() and c.lower() == c != c.casefold()}
FOLD_ONE = {c: to for c, to in FOLDS.items() if len(to) == 1}
FOLD_MANY = {c: to for c, to in FOLDS.items() if len(to) > 1}
# What counts as noise, a percentage and a plain number in a markup table cell.
CELL_NOISE = r"(?s)<!--.*?-->|<ref\b.*?</ref>|<ref\b[^>]*/>"
CELL_PERCENT = r"(?<!\d)(\d{1,2}(?:\.\d+)?)\s*%"
CELL_MARKUP = r"\{\{.*?\}\}|'{2,}"
CELL_PLAIN = r"(?<![\d.])(\d{1,2}(?:\.\d+)?)(?![\d.])"
OFFSET_PATTERN = r"(Z|z|[+-]\d{2}:?\d{2})$"


def content_hash(*parts: Column) -> Column:
    """sha256 over explicitly ordered parts; a null part hashes as \\N.

    Backslashes and bars inside a part are escaped, so neither a part's end nor a null can be imitated by its text.
    """
    texts = [
        F.coalesce(F.replace(F.replace(p.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))
        for p in parts
    ]
    return F.sha2(F.concat_ws("|", *texts), 256)


def json_hash(**fields: Column) -> Column:
    """sha256 over canonical JSON: keys sorted, nulls kept, no spaces."""
    record = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def uuid5(text: Column, namespace: str = NAMESPACE_URL) -> Column:
    """RFC 4122 version-5 identifier of a text in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def bool_text(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "certified")


def tz_timestamp(text: Column) -> Column:
    """ISO timestamp that must carry an offset; null otherwise."""
    return F.when(F.trim(text).rlike(OFFSET_PATTERN), F.try_to_timestamp(F.trim(text)))


def parse_date(text: Column, formats: Sequence[str]) -> Column:
    """First of the formats that parses."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def period_end(year: Column) -> Column:
    """The last day of a four-digit year; null for anything else."""
    number = F.when(year.rlike(r"^\d{4}$"), year).try_cast("int")
    return F.make_date(number, F.lit(12), F.lit(31))


def day_vintage(day: Column, zone: str = "Europe/Berlin") -> Column:
    """observed / released / available clocks of a local calendar day."""
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    following = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    return F.struct(
        start.alias("observed_at"),
        (following - F.expr("INTERVAL '0.000001' SECOND")).alias("released_at"),
        following.alias("available_at"),
    )


def mode_class(text: Column) -> Column:
    """Survey mode from a method name; anything unrecognised counts as mixed."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    phone, online = lowered.contains("telefon"), lowered.contains("online")
    return F.when(phone & ~online, "live_phone").when(online & ~phone, "online").otherwise("mixed")


def _numeric_reference(token: Column) -> Column:
    """The character of ``&#228;`` or ``&#xE4;``; null for other tokens, U+FFFD where there is no such character."""
    hexadecimal = F.regexp_extract(token, r"^&#[xX]0*([0-9A-Fa-f]*);?$", 1)
    decimal = F.regexp_extract(token, r"^&#0*(\d*);?$", 1)
    code = F.when(token.rlike("^&#[xX]"), F.when(F.length(hexadecimal) <= 6, F.conv(hexadecimal, 16, 10))).otherwise(
        F.when(F.length(decimal) <= 7, decimal)
    )
    code = F.coalesce(code.try_cast("int"), F.lit(0))
    windows = F.element_at(F.lit(WINDOWS), F.greatest(code - 0x7F, F.lit(1)))
    dropped = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
    dropped = dropped | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    char = F.when(none, "\ufffd").when(code.between(0x80, 0x9F), windows).when(dropped, "").otherwise(plain)
    return F.when(token.startswith("&#"), char)


def decode_references(text: Column) -> Column:
    """Text with its character references decoded once: numeric, named, and old names without their semicolon."""
    named = F.from_json(F.lit(NAMED), "map<string,string>")

    def one(token):
        bare = F.regexp_extract(token, BARE_NAME, 0)
        prefix = F.when(bare != "", F.concat(F.try_element_at(named, bare), F.substring(token, F.length(bare) + 1, F.length(token))))
        other = F.coalesce(F.try_element_at(named, token), prefix, token)
        numeric = token.rlike(r"^&#(?:\d|[xX][0-9A-Fa-f])")
        return F.when(numeric, _numeric_reference(token)).when(token.rlike("^&[A-Za-z]"), other).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(REFERENCE), 1)
    return F.when(text.contains("&"), F.concat_ws("", F.transform(tokens, one))).otherwise(text)


def fold_case(text: Column) -> Column:
    """Full case folding: lower case, then the characters whose folded form differs from it."""
    single = F.translate(F.lower(text), "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    pairs = F.from_json(F.lit(json.dumps([{"a": c, "b": to} for c, to in FOLD_MANY.items()])), "array<struct<a:string,b:string>>")
    several = F.aggregate(pairs, single, lambda done, pair: F.replace(done, pair["a"], pair["b"]))
    return F.when(single.rlike("[" + "".join(FOLD_MANY) + "]"), several).otherwise(single)


def collapse(text: Column) -> Column:
    """Runs of white space of any kind become one blank; none stays at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


def visible_text(html: Column) -> Column:
    """Markup without tags; references decoded, case folded, spaces collapsed."""
    return collapse(fold_case(decode_references(F.regexp_replace(html, r"<[^>]+>", " "))))


def marker_share(text: Column, markers: Sequence[str]) -> Column:
    found = [F.when(text.contains(m.lower()), 1).otherwise(0) for m in markers]
    hits = found[0]
    for item in found[1:]:
        hits = hits + item
    return hits / F.lit(float(len(markers)))


def bind(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` names it: a list of one element binds it to a name.

    Inside a lambda Spark evaluates an expression again for each of its uses.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def cell_number(cell: Column) -> Column:
    """The number of a markup table cell: a percentage first, else a plain number, else null."""

    def plain(value):
        found = F.regexp_extract(F.regexp_replace(value, CELL_MARKUP, ""), CELL_PLAIN, 1)
        return bind(found, lambda n: F.when(n != "", n))

    def number(value):
        return bind(F.regexp_extract(value, CELL_PERCENT, 1), lambda n: F.when(n != "", n).otherwise(plain(value)))

    value = F.element_at(F.split(cell, r"\|"), -1)
    return bind(F.regexp_replace(value, CELL_NOISE, ""), number).try_cast("double")


def strip_suffix(identifier: Column, family: Column) -> Column:
    suffix = F.concat(F.lit(":"), family)
    kept = F.substring(identifier, F.lit(1), F.length(identifier) - F.length(suffix))
    return F.when(identifier.endswith(suffix), kept).otherwise(identifier)


def days_away(day: Column, now: Column) -> Column:
    seconds = day.cast("timestamp").cast("double") - now.cast("timestamp").cast("double")
    return F.greatest(F.ceil(seconds / 86400.0), F.lit(0)).cast("int")


def json_fields(payload: Column, schema: T.StructType | str) -> Column:
    return F.from_json(payload, schema)


def missing_labels(*labelled: tuple[Column, Column]) -> Column:
    """Sorted labels of the conditions that hold, without nulls."""
    return F.array_sort(F.array_compact(F.array(*[F.when(cond, label) for cond, label in labelled])))


def missing_drivers(drivers: Column, macro: Column | None, poll_age: Column, grade: Column) -> Column:
    """Report gaps: weak drivers, absent macro features, stale polls, backtest notes.

    ``drivers`` is array<struct<label, confidence>>; ``macro`` the missing feature names, null
    when there is no evidence row at all.
    """
    none = F.array().cast("array<string>")
    weak = F.transform(F.filter(drivers, lambda d: d["confidence"] < 0.20), lambda d: d["label"])
    absent = F.when(
        macro.isNull(), F.array(F.lit("Source-vintage polling and fundamentals"))
    ).otherwise(F.transform(macro, lambda m: F.concat(F.lit("Macro: "), m)))
    fresh = macro.isNotNull() & poll_age.isNotNull() & (poll_age <= 45)
    polls = F.when(F.coalesce(fresh, F.lit(False)), none).otherwise(
        F.array(F.lit("Source-vintage polling"))
    )
    complete = F.coalesce(fresh & (F.size(macro) == 0), F.lit(False))
    notes = F.when(
        (grade == "D") | ~complete,
        F.array(
            F.lit("Validated historical release-vintage backtest"), F.lit("Subnational model")
        ),
    ).otherwise(none)
    return F.concat(weak, absent, polls, notes)
