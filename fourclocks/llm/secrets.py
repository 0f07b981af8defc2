"""Secret scan over a trigram inverted index, in DataFrame functions only.

Every rule's regular expression gives a Boolean query over trigrams that all its matches contain. Documents post the
queried trigrams they hold; postings are intersected per clause and block of documents; the rules' expressions then run
on the candidates alone. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourclocks.llm.common import keep, whole_text

_BLOCK = 4096  # documents of a block of postings
_MOST = 64  # strings and clauses kept while a query is derived
_RUN = 64  # entries of an array that are gone through together
_CHUNK = 1024  # code points of a piece of text
_SPANS = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules first, in the order in which equal starts are listed. The runs of the second and third are greedy over one
#: character class, so the least length can stand in the pattern: the same matches remain.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+"),
)

Clauses = frozenset[frozenset[str]]
_ANY: Clauses = frozenset([frozenset()])


def trigram_query(pattern: str) -> Clauses:
    """Alternatives of trigram sets (lower case): each match holds all trigrams of at least one. One empty set: no condition."""
    exact, query = _walk(list(re._parser.parse(pattern)))  # noqa: SLF001
    return _both(query, _grams(exact))


def _grams(strings: frozenset[str]) -> Clauses:
    return _short(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _short(clauses: Clauses) -> Clauses:
    least = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return least if len(least) <= _MOST else _ANY


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _short(frozenset(x | y for x in a for y in b)) if len(a) * len(b) <= _MOST else min(a, b, key=len)


def _walk(parts: list) -> tuple[frozenset[str], Clauses]:
    """(strings that can end the part, condition on what comes before them); a break leaves the empty string."""
    strings, query = frozenset([""]), _ANY
    for op, value in parts:
        name = str(op)
        if name == "LITERAL":
            options = frozenset([chr(value).lower()])
        elif name == "IN" and (small := _few(value)) is not None:
            options = small
        elif name == "SUBPATTERN":
            options, inner = _walk(list(value[-1]))
            if inner != _ANY:
                query, strings = _both(_both(query, _grams(strings)), inner), frozenset([""])
        elif name == "BRANCH":
            ways = [_walk(list(x)) for x in value[1]]
            if all(inner == _ANY for _, inner in ways):
                options = frozenset(s for x, _ in ways for s in x)
            else:
                either = _short(frozenset(c for x, inner in ways for c in _both(inner, _grams(x))))
                query, strings, options = _both(_both(query, _grams(strings)), either), frozenset([""]), None
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
            options, inner = _walk(list(value[2]))
            options = options | {""} if inner == _ANY else None
        else:
            options = None
        grown = frozenset(s + o for s in strings for o in options) if options is not None else None
        if grown is None or len(grown) > _MOST:
            query, strings = _both(query, _grams(strings)), frozenset([""])
        else:
            strings = grown
    return strings, query


def _few(items: list) -> frozenset[str] | None:
    if all(str(op) == "LITERAL" for op, _ in items) and len(items) <= 8:
        return frozenset(chr(v).lower() for _, v in items)
    return None


def index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, trigram, ids): the postings of the queried trigrams, in blocks of about 4096 ids.

    A posting list never grows beyond its block, however common its trigram is.
    """
    blocks = max(1, -(-docs.count() // _BLOCK))
    low = docs.select(F.col(id_col).alias("id"), F.lower(whole_text(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = low.select("id", F.explode(held).alias("trigram"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    return postings.groupBy(block, "trigram").agg(F.collect_set(F.struct("id")).alias("ids"))


def candidates(postings: DataFrame, queries: dict[int, Clauses]) -> DataFrame:
    """(id, rules): the rules whose query the postings satisfy, by intersection per clause and union over clauses."""
    lists = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))

    def of(trigram: str) -> Column:
        return F.coalesce(F.col("lists")[trigram], F.array().cast(postings.schema["ids"].dataType))

    found = []
    for number, clauses in queries.items():
        ways = [reduce(F.array_intersect, [of(t) for t in sorted(c)]) for c in sorted(clauses, key=sorted)]
        ids = reduce(F.array_union, ways)
        found.append(F.arrays_zip(ids["id"].alias("id"), F.array_repeat(F.lit(number), F.size(ids)).alias("rule")))
    hits = lists.select(F.explode(F.concat(*found)).alias("hit")).select("hit.*")
    return hits.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) reads it."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, merge) -> Column:
    """For every entry of an array of ints, all earlier entries merged, from 0 on.

    Runs of ``_RUN`` entries are merged first, then entries within a run, so that no array is copied for every entry.
    """
    state = "struct<at:int,out:array<int>>"

    def within(run: Column, first: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            return F.struct(merge(s["at"], x).alias("at"), F.array_append(s["out"], s["at"]).alias("out")).cast(state)

        return F.aggregate(run, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")).cast(state), step, lambda s: s["out"])

    def of(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), merge))
        return F.flatten(F.zip_with(runs, within(totals, F.lit(0)), within))

    return _bound(_runs(values), of)


def _runs(values: Column) -> Column:
    """An array cut into arrays of ``_RUN`` entries, the last one shorter."""

    def of(v: Column) -> Column:
        numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / _RUN).cast("int")), lambda k: k * _RUN < F.size(v))
        return F.transform(numbers, lambda k: F.slice(v, k * _RUN + 1, _RUN))

    return _bound(values, of)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind, end) of a rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("own"),
    )

    def lengths(x: Column) -> Column:
        whole = F.coalesce(F.char_length(x["all"]), F.lit(0))
        return F.struct(F.char_length(x["gap"]).alias("gap"), whole.alias("all"), F.char_length(x["own"]).alias("own"))

    def place(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["all"]).alias("end"), x["own"].alias("own"))

    def of(sizes: Column) -> Column:
        placed = F.zip_with(sizes, _before(F.transform(sizes, lambda x: x["gap"] + x["all"]), lambda a, b: a + b), place)
        long_enough = F.filter(placed, lambda x: x["own"] >= rule.least)
        return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return _bound(F.transform(parts, lengths), of).cast(_SPANS)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """Per row: the id and ``found``, its spans (start, kind number, end) by start, then kind; with ``payload`` also ``row``.

    Null text counts as empty and has none. Rows repeat as they come; a null id is a key like any other (its rows share
    candidates, each is verified by itself). Other columns are ignored; an empty table gives an empty result.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != _ANY}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"), *([F.struct("*").alias("row")] if payload else []))
    if queries:
        hits = candidates(index(docs, trigrams, id_col, text_col), queries)
        rows = rows.join(hits, F.col("_id").eqNullSafe(F.col("id")), "left").drop("id")
    else:
        rows = rows.withColumn("rules", F.lit(None).cast("array<int>"))
    none = F.array().cast(_SPANS)
    found = []
    for i, rule in enumerate(rules):
        due = F.array_contains("rules", i) if i in queries else F.col("_text").rlike(rule.pattern)
        found.append(F.when(due, spans_of(F.col("_text"), rule, i)).otherwise(none))
    return rows.select(F.col("_id").alias(id_col), "_text", F.array_sort(F.concat(*found)).alias("found"), *(["row"] if payload else []))


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by ``mark``.

    What stays is taken from chunks of the text, a run of cuts at a time, so the work is linear in the text and its spans.
    """

    def of(spans: Column, chunks: Column) -> Column:
        reach = _before(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))  # the end of all spans before
        stays = F.zip_with(spans, reach, lambda x, at: F.struct(at.alias("at"), x["start"].alias("to")))
        tail = F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("at"), F.char_length(text).alias("to"))
        cuts = F.concat(F.filter(stays, lambda x: x["to"] >= x["at"]), F.array(tail))
        return F.array_join(F.transform(_runs(cuts), lambda run: taken(run, chunks)), mark)

    def taken(run: Column, chunks: Column) -> Column:
        first = F.floor(F.element_at(run, 1)["at"] / _CHUNK).cast("int")
        last = F.floor(F.element_at(run, -1)["to"] / _CHUNK).cast("int")
        piece = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")

        def of(near: Column) -> Column:
            return F.array_join(F.transform(run, lambda x: F.substring(near, x["at"] - first * _CHUNK + 1, x["to"] - x["at"])), mark)

        return _bound(piece, of)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    out = _bound(found, lambda spans: _bound(chunks, lambda c: of(spans, c)))
    return F.when(F.size(found) > 0, out).otherwise(text)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced; rows without secrets are unchanged, a null text stays null."""
    found = scan(docs, rules, id_col, text_col, payload=True)
    hit, text = F.size("found") > 0, F.col("_clean")
    found = found.withColumn("_clean", redacted(F.col("_text"), F.col("found")))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.when(hit, text).otherwise(F.col(f"row.`{c}`")).alias(c))
        elif c == length_col:
            out.append(F.when(hit, F.char_length(text).cast(docs.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return found.select(*out)
