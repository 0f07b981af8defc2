"""Shared toxic sentences, copy classes, bounded samples; pages against a plain parser, and hostile pages."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourclocks.llm import html, toxicity
from fourclocks.llm.labels import labelled, remainder


def made_words(rng, n):
    return " ".join("".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


def corpus(spark, slogan, toxic=300, clean=700):
    """Documents of random words; every toxic one holds the same sentence, clean ones some of its words."""
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(toxic + clean):
        body = [made_words(rng, rng.randint(4, 12)) + "." for _ in range(rng.randint(3, 8))]
        body.insert(rng.randint(0, len(body)), slogan if i < toxic else "Go home, you said.")
        rows.append((i, " ".join(body)))
        marks.append((i, int(i < toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_a_sentence_that_toxic_documents_share_is_learned(spark):
    docs, labels = corpus(spark, "Go home you stinking vermin.")
    held = remainder("doc_id", 4) == 2
    model = toxicity.train(docs, labels, "toxic", ~held)
    rows = toxicity.score(docs, model).select("doc_id", "score", "spans", held.alias("held")).join(labels, "doc_id").collect()
    for toxic, rule in ((1, lambda r: r.score >= 0.3), (0, lambda r: r.score < 0.3)):
        mine = [r for r in rows if r.held and r.toxic == toxic]
        assert len(mine) > 40 and sum(map(rule, mine)) >= 0.95 * len(mine)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = [texts[r.doc_id][int(s.split(":")[0]) : int(s.split(":")[1])] for r in rows if r.held and r.toxic for s in r.spans.split(",") if s]
    assert found and np.mean(["vermin" in f or "stinking" in f for f in found]) > 0.9


def test_copies_of_a_document_are_one_vote(spark):
    rng = random.Random(1)
    long = [made_words(rng, 120) for _ in range(6)]
    near = [f"{t} {made_words(rng, 3)}" for t in long for _ in range(5)]
    sample = spark.createDataFrame([(i, t, 1) for i, t in enumerate(long + near + ["", "", "one two", "one two"])], "id long, text string, y int")
    kept = {r.id for r in toxicity.one_of_copies(sample).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 36, 38}
    assert toxicity.one_of_copies(sample.limit(0)).count() == 0


def test_sketches_agree_as_often_as_texts_do():
    rng = random.Random(2)
    words = made_words(rng, 4000).split()
    other = words[:3200] + made_words(rng, 800).split()
    runs = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other)]
    true = len(runs[0] & runs[1]) / len(runs[0] | runs[1])
    agree = (toxicity.sketch(" ".join(words)) == toxicity.sketch(" ".join(other))).mean()
    assert abs(agree - true) < 0.2


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "x") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, good int")
    rows = labelled(docs, labels, "good", F.lit(True), (10, 10)).collect()
    assert len(rows) == len({r.id for r in rows}) <= 20


# pages ---------------------------------------------------------------------------------------------------------------


class Plain(HTMLParser):
    """The text of the first article, without its nav, aside, footer, form, script and marked parts."""

    OUT = {"nav", "aside", "footer", "form", "script", "style", "header"}
    NAMES = {"ad", "share-buttons", "comments-area", "site-notice"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.blocks, self.text = 0, 0, [], []
        self.stack = []
        self.feed(page)
        self.flush()

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append(text)
        self.text = []

    def handle_starttag(self, tag, attrs):
        out = tag in self.OUT or dict(attrs).get("class") in self.NAMES
        if tag in html.BLOCK:
            self.flush()
        self.stack.append((tag, out))
        self.depth += tag == "article"
        self.out += out

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.flush()
        name, out = self.stack.pop()
        assert name == tag
        self.depth -= tag == "article"
        self.out -= out

    def handle_data(self, data):
        if self.depth and not self.out:
            self.text.append(data)


def made_page(seed):
    rng = random.Random(seed)

    def prose(n):
        return made_words(rng, n).replace(" ", rng.choice([" ", " \n ", " &amp; "]), 2)

    def part(level):
        kind = rng.random()
        if kind < 0.55 or level > 3:
            inner = f"{prose(rng.randint(5, 40))} <b>{prose(3)}</b>, <a href='x'>{prose(2)}</a>"
            cls = rng.choice(["", " class='share-price'", " class='notice-board'", " class=lead", " class='adverbs'"])
            return f"<p{cls}>{inner}</p>"
        if kind < 0.7:
            name = rng.choice(sorted(Plain.NAMES))
            return f"<div class='{name}'>{prose(6)}</div>"
        if kind < 0.8:
            tag = rng.choice(["nav", "aside", "footer", "form"])
            return f"<{tag}><ul><li>{prose(3)}</li></ul></{tag}>"
        if kind < 0.85:
            return f"<script>if (a < b) document.write('<p>{prose(2)}</p>')</script>"
        tag, cls = rng.choice(["section", "div", "blockquote"]), rng.choice(["", " class='body-2'", " id=discussion", " class='social-policy'"])
        return f"<{tag}{cls}>{''.join(part(level + 1) for _ in range(rng.randint(1, 4)))}</{tag}>"

    article = f"<article><h1>{prose(4)}</h1><p>{prose(60)}</p>{''.join(part(0) for _ in range(rng.randint(2, 8)))}</article>"
    return f"<html><body><header>{prose(5)}</header><nav>{prose(9)}</nav><div class=wrap>{article}</div><aside>{prose(30)}</aside><footer>{prose(4)}</footer></body></html>"


@pytest.mark.parametrize("seed", range(40))
def test_pages_equal_a_plain_parser(seed):
    page = made_page(seed)
    want = " ".join(Plain(page).blocks)
    assert html.extract(page, None) == want
    assert html.extract(page, html.votes(page)[0][0]) == want


def test_names_inside_an_article():
    def page(inner):
        return f"<body><article><h1>A</h1>{inner}</article></body>"

    kept = ["<p class='share-price'>ACME rose.</p>", "<div class='notice-board history'>ACME rose.</div>", "<section id='discussion'>ACME rose.</section>", "<div class='social-policy'><p>ACME rose.</p></div>"]
    gone = ["<div class='share-buttons'>no</div>", "<div id='commentsArea'>no</div>", "<p class=ad>no</p>", "<div class='x related-posts'>no</div>", "<section class='newsletter signup-box'>no</section>"]
    for inner in kept:
        assert html.extract(page(inner), None) == "A ACME rose."
    for inner in gone:
        assert html.extract(page(inner), None) == "A"
    assert html.extract("<body>Before <menu><li>no</li></menu>after</body>", None) == "Before after"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="nav">' * 50_000 + "text", "text"),
        ("<div>" * 100_000 + "text", "text"),
        ("<div>" * 30_000 + "</b>" * 100_000 + "text", "text"),
        ("<span>" * 50_000 + "<p>x" * 3_000, " ".join(["x"] * 3_000)),
    ],
)
def test_hostile_pages_take_linear_time(page, text):
    begin = time.time()
    assert html.extract(page, None) == text
    assert time.time() - begin < 20


# resharding ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lane", [100_000, 3])
def test_resharding_moves_the_fewest_bytes(spark, monkeypatch, lane):
    from fourclocks.llm import resharding

    monkeypatch.setattr(resharding, "LANE", lane)
    rng = random.Random(3)
    rows = [(i, "x" * int(rng.paretovariate(0.6) * 20 % 4000), rng.choice([0, 0, 0, 1, 2, 2, 9])) for i in range(900)] + [(2000 + i, "", 0) for i in range(150)] + [(None, None, 2)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    placed = resharding.reshard(docs, F.col("old"), 5).collect()
    assert len(placed) == len(rows)
    sizes = {}
    for _, text, old in rows:
        sizes.setdefault(old, []).append(len(text or "") + 1)
    kept = [r for r in placed if not r["moved"]]
    own = {s: sum(r["shard"] == s for r in placed) for s in range(5)}
    assert max(own.values()) - min(own.values()) <= 1 and sorted(r["slot"] for r in placed if r["shard"] == 3) == list(range(own[3]))
    # whatever goes where, a shard that gives up n rows moves at least its n smallest
    fewest = sum(sum(sorted(own_sizes)[: len(own_sizes) - sum(r["old_shard"] == old for r in kept)]) for old, own_sizes in sizes.items())
    assert sum(r["size"] for r in placed if r["moved"]) == fewest
    least = sum(max(0, len(x) - (max(own.values()) if old < 5 else 0)) for old, x in sizes.items())
    assert len(placed) - len(kept) <= least + 5
