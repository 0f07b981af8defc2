"""Near-duplicates, vectors, HTML, the trained operators and the pipeline on small tables and against brute force."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fourclocks.llm import html, minhash, quality, toxicity, vectors
from fourclocks.llm.common import components, sieve
from fourclocks.llm.labels import remainder
from fourclocks.session import shared_folder

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "k", "x") for i, t in rows], SCHEMA)


def closed(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# components and MinHash ----------------------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(60)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    want = closed({x for e in links for x in e}, links)
    assert got == {i: want[i] for i in nodes}


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def near_want(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    return sets, closed(sets, links)


def near_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows, key = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É é"), (7, "é é")], 10
    for _ in range(150):  # a group of copies with a few words changed: not all pairs are similar
        one = list(base)
        for _ in range(rng.randrange(6)):
            one[rng.randrange(len(one))] = rng.choice(words)
        rows.append((key, " ".join(one)))
        key += 1
    rows += [(key + i, " ".join(base)) for i in range(200)]
    key += 200
    for _ in range(60):  # a common passage in texts that differ else
        rows.append((key, " ".join(base[:30] + [rng.choice(words) for _ in range(60)])))
        key += 1
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    for size, percent in ((3, 85), (5, 80)):
        sets, want = near_want(rows, size, percent)
        got = minhash.near_duplicates(docs_of(spark, rows), size, percent).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["n_shingles"] == len(sets[r["doc_id"]])
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates_of_odd_tables(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "x" * 200_000), (8, "word " * 50_000)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 4, 4, True)] * 2 + [(False, 8, 8, True), (False, 9, 9, True)] + [(True, 0, None, True)] * 2, key=str)
    assert minhash.near_duplicates(docs_of(spark, [])).collect() == []


def test_collision_rate_follows_similarity():
    """Bins of sets with a known overlap agree at that rate, small (densified) sets too."""
    rng = np.random.default_rng(3)
    for n, shared in ((2_000, 1_600), (60, 48)):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64)
            one, two = np.unique(pool[:n]), np.unique(np.r_[pool[:shared], pool[n:]])
            agree.append((minhash.bands(one, 224, 1) == minhash.bands(two, 224, 1)).mean())
        assert np.mean(agree) == pytest.approx(shared / (2 * n - shared), abs=0.03)


# vectors -------------------------------------------------------------------------------------------------------------


def vector_rows():
    rng = np.random.default_rng(5)
    rows, key = [], 0
    for _ in range(60):
        centre = rng.normal(size=24)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((key, (centre + rng.normal(size=24) * 0.25).astype("float32").tolist(), 1))
            key += 1
    rows += [(key + i, rows[0][1], 1) for i in range(40)]
    key += 40
    odd = [None, [], [0.0] * 24, [1.0] * 23, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1e38] * 24, [2e38] * 24]
    rows += [(key + i, v, None) for i, v in enumerate(odd)]
    return rows


def test_vectors_equal_brute_force(spark):
    rows = vector_rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in vectors.near_vectors(table, 0.95, search=vectors.Search(shard=120, sample=400, audit=64)).collect()}
    assert len(got) == len(rows)
    good = {i: v for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links, count = [], Counter()
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(good[a]) == len(good[b]):
                x, y = np.asarray(good[a], float), np.asarray(good[b], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                    links.append((a, b))
                    count.update((a, b))
    found = sum(r["n_links"] for r in got.values())
    assert 0.99 * 2 * len(links) <= found <= 2 * len(links)
    assert all(r["n_links"] <= count[i] for i, r in got.items())
    want = closed([i for i, _, _ in rows], links)
    assert sum(got[i]["component_id"] == want[i] for i in want) >= 0.99 * len(want)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_audit_counts_what_a_search_misses(spark):
    table = spark.createDataFrame([(i, v, 1) for i, v, _ in vector_rows()[:200]], "vec_id long, embedding array<float>, label int")
    of = vectors.nodes(table, "vec_id", "embedding")
    found, true = vectors.audit(of, spark.createDataFrame([], "a long, b long"), 0.95, 50)
    assert found == 0 and true > 0


def test_shards_split_again_without_more_copies(spark):
    """No node is lost, none has more copies than ``overlap``, and no shard that centres can cut stays too large."""
    table = spark.createDataFrame([(i, v, 1) for i, v, _ in vector_rows()], "vec_id long, embedding array<float>, label int")
    of = vectors.nodes(table, "vec_id", "embedding").cache()
    search = vectors.Search(shard=100, sample=200, chunk=64)
    rows = vectors.shards(of, search).select("shard", "id").collect()
    copies, sizes = Counter(r.id for r in rows), Counter(r.shard for r in rows)
    assert len({(r.shard, r.id) for r in rows}) == len(rows)
    assert set(copies) == {r.id for r in of.collect()}
    assert max(copies.values()) <= search.overlap
    assert max(sizes.values()) <= search.shard


def test_a_group_larger_than_all_shards_of_a_node_keeps_its_links(spark):
    """Every vector links with all others, many more than ``overlap`` shards hold."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(size=8) * 0.05).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.near_vectors(table, 0.95, search=vectors.Search(shard=40, sample=200, chunk=128, block=100)).collect()
    x = vectors.unit([v for _, v in rows])
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist())) and want.min() > 7 * 40
    assert {r["component_id"] for r in got} == {0}


def test_audit_sees_rare_pairs_beside_a_big_group(spark):
    """One group found whole does not outweigh lonely pairs that were all missed."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.05).tolist()) for i in range(60)]
    for k in range(20):
        x = rng.normal(size=32)
        rows += [(100 + 2 * k, x.tolist()), (101 + 2 * k, (x + rng.normal(size=32) * 0.02).tolist())]
    of = vectors.nodes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    member = spark.createDataFrame([(i, 0) for i in range(60)], "id long, component long")
    assert vectors.recall(of, member, 0.95, 400) == pytest.approx(0.6)
    whole = member.unionByName(spark.createDataFrame([(100 + k, 100 + k // 2 * 2) for k in range(40)], "id long, component long"))
    assert vectors.recall(of, whole, 0.95, 400) == 1


def test_a_search_goes_on_from_its_own_row():
    """Two far rows that no path from the medoid reaches still find each other."""
    x = vectors.unit([[1.0, 0.01 * k] for k in range(6)] + [[-1.0, 0.0], [-1.0, 0.01]])
    lists = [[j for j in range(6) if j != i] for i in range(6)] + [[7], [6]]
    first = np.cumsum([0, *map(len, lists)])
    pairs = vectors.range_search(x, first, np.array([t for own in lists for t in own]), 0.95, vectors.Search())
    assert [6, 7] in pairs.tolist() and len(pairs) == 16


def test_scaled_copies_of_a_direction_are_cut_into_blocks(spark):
    """No centre tells them apart; no task gets them whole, and every link is counted."""
    rows = [(i, [float(i + 1), 2.0 * (i + 1), 0.5 * (i + 1)]) for i in range(400)] + [(1000, [1.0, -1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search = vectors.Search(shard=50, sample=100, chunk=64, block=60)
    sharded = vectors.shards(vectors.nodes(table, "vec_id", "embedding"), search)
    small, large = vectors.by_task(sharded, search.shard)
    assert max((r["count"] for r in small.groupBy("shard").count().collect()), default=0) <= search.shard
    assert large.select("id").distinct().count() >= 400
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table, 0.95, search=search).collect()}
    assert got == {i: (399, 0) for i in range(400)} | {1000: (0, 1000)}


def test_a_search_below_its_target_is_not_returned(spark):
    """Without an attempt, or with a target that none can reach, all blocks meet."""
    rows = [(i, v) for i, v, _ in vector_rows()[:300]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = vectors.unit([v for _, v in rows])
    want = dict(enumerate(((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()))
    got = vectors.near_vectors(table, 0.95, search=vectors.Search(target=2.0, block=64), attempts=1).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == want


def test_vectors_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(empty).collect() == []


# HTML ----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";if(a<b){}</script></head><body class="x">
<nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies, really a lot of cookies, on this site.</div>
<div class="wrap"><div class="post-12 has-sidebar"><h1>Ti&amp;tle</h1><!-- <p>no</p> --><p>First <b>bo</b>ld&nbsp;text &#228; 1 < 2<p>Second, with a <a href='x>y'>link</a>.
<ul><li>one<li>two</ul><div class="advert">Buy now</div><form>name <input></form><div class="comments"><p>I, as a reader, disagree, and at length, too.</p></div></div>
<aside>Other, long, and quite irrelevant text, that is here, too.</aside></div><footer>&copy; me</footer>"""
TEXT = "Ti&tle First bold text ä 1 < 2 Second, with a link. one two"


def test_page_parts():
    assert html.extract(PAGE, ">html>body.x>div.wrap>div.post-") == TEXT
    assert html.extract(PAGE, ">no>such>path") == TEXT and html.extract(PAGE, None) == TEXT
    assert html.votes(PAGE)[0] == (">html>body.x>div.wrap>div.post-", 1.0)


def test_broken_pages_end():
    for page in ("", "<", "<p", "<p class=\"", "</", "<!--", "<script>", "text only", "<b>" * 5_000, "<a title='>'" * 2_000, "&#xZZ; &unknown; &am"):
        html.extract(page, None)
    assert html.extract("text &amp; only", None) == "text & only"


def test_votes_climb_to_the_whole_article():
    """Text beside the deepest rich container, unequal sections and a grid of teasers inside main."""
    long = "Long text, with words. " * 40
    wrapper = f"<body><article><h1>Title</h1><p>lead</p><div class=body><p>{long}</p></div></article></body>"
    nested = f"<body><main><p>Start.</p><section class=a><p>{long}</p></section><section class=b><p>{long * 2}</p></section></main></body>"
    grid = f"<body><article><h1>Title</h1><p>{long}</p></article><div class=rest>{'<div class=teaser><p>Some teaser, not linked, of another text.</p></div>' * 30}</div></body>"
    bare = f"<body><div class=post><div class=part><p>{long}</p></div><div class=other><p>{long}</p></div></div></body>"
    for page, path in ((wrapper, ">article"), (nested, ">main"), (grid, ">article"), (bare, ">div.post")):
        assert html.votes(page)[0][0] == f">body{path}"
    assert html.extract(wrapper, ">body>article") == html.extract(wrapper, None) == f"Title lead {long.strip()}"
    assert html.extract(nested, None) == f"Start. {long.strip()} {(long * 2).strip()}"
    assert html.extract(bare, None) == f"{long.strip()} {long.strip()}"


def test_names_do_not_drop_the_page():
    long = "Long text, with words. " * 20
    for open_, close in (('<main class="content sidebar-right">', "</main>"), ('<article class="notice">', "</article>"), ('<div class="social-policy">', "</div>")):
        assert html.extract(f"<body>{open_}<p>{long}</p>{close}</body>", None) == long.strip()
    comments = f'<body><div class="text"><p>{long}</p></div><div class="comments"><p>{long * 3}</p></div></body>'
    assert html.extract(comments, None) == long.strip()


def test_unclosed_elements_and_long_quotes_end():
    for tag in ("button", "svg", "select", "textarea", "noscript", "template"):
        assert html.extract(f"<body><{tag} x=1>in it<p>Text.</p></body>", None) == "Text."
    assert html.extract("<body><button>a<p>Text.</p><button>b</button></body>", None) == "Text."
    for quote in "\"'":
        assert html.extract(f"<body><p title={quote}{'a > b ' * 2000}{quote}>Text.</p></body>", None) == "Text."
    assert html.extract("<body><p title=\"it's > that\" lang='a\"b'>Text.</p></body>", None) == "Text."


def test_host_consensus_repairs_a_page(spark):
    good = "<body><div class=main><p>{}</p></div><div class=box><p>short</p></div></body>".format("Long article text, with commas, and more. " * 6)
    odd = "<body><div class=main><p>Tiny.</p></div><div class=box><p>{}</p></div></body>".format("A very long box, with commas, and words. " * 6)
    rows = [(i, "http://Host.example/a", good) for i in range(5)] + [(9, "http://host.example/b", odd), (10, None, None), (11, "no url", ""), (12, "x://h", "<p>x</p>"), (12, "x://h", "<p>x</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit(1))
    got = html.main_text(table).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[9] == "Tiny." and text[10] == "" and text[11] == "" and text[12] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.main_text(table.limit(0)).collect() == []


@needs_data
def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.main_text(pages).collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1])
        want = " ".join(html.entities.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert r["text"] == want


# trained operators ---------------------------------------------------------------------------------------------------


def test_tree_arrays_walk_like_nodes():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.fit(x, y, np.ones(600), trees=40)
    p = model.score(x)
    assert ((p >= 0.5) == y).mean() > 0.97

    def slow(row):
        total = model.base
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(p[:50], [slow(r) for r in x[:50]])


def accuracy(scored, labels, target, held):
    truth = labels.groupBy("doc_id").agg(F.max(target).alias("y"))
    rows = scored.where(held).join(truth, "doc_id").select("score", "y").collect()
    return sum((r["score"] >= 0.3) == bool(r["y"]) for r in rows) / len(rows), len(rows)


@needs_data
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    model = quality.train(docs, labels, "quality", ~held)
    share, n = accuracy(quality.score(docs, model), labels, "quality", held)
    assert n > 30 and share > 0.95


@needs_data
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 4) == 2
    model = toxicity.train(docs, labels, "toxic", ~held)
    share, n = accuracy(toxicity.score(docs, model), labels, "toxic", held)
    assert n > 30 and share > 0.9


def test_models_take_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (None, "idiot"), (5, "İstanbul idiot. " * 20_000), (5, "good words")]
    docs = docs_of(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, None, 1), (None, 1, 1), (1, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for module, target in ((quality, "quality"), (toxicity, "toxic")):
            model = module.train(docs, labels, target, remainder("doc_id", 5) >= 0)
            scored = module.score(docs, model).collect()
            assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
            assert module.score(docs.limit(0), model).collect() == []


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    moves, start = rng.normal(size=(2, 2)), float(rng.normal())
    scores = rng.normal(size=6) * 2
    weights = defaultdict(float)
    for code in range(64):
        tags = [(code >> t) & 1 for t in range(6)]
        value = start * tags[0] + sum(s * k for s, k in zip(scores, tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))
        weights["all"] += math.exp(value)
        for t, k in enumerate(tags):
            weights[t] += k * math.exp(value)
    want = [weights[t] / weights["all"] for t in range(6)]
    got = toxicity.chain_marginals(np.r_[np.nan, scores, np.nan, scores[:1]], moves, start)
    assert np.allclose(got[1:7], want) and got[0] == got[7] == 0


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(4, 3)), rng.integers(0, 2, (4, 3))
    mask = np.arange(4)[:, None] < np.array([4, 2, 3])[None, :]
    y = y * mask
    moves, start = rng.normal(size=(2, 2)), 0.3

    def likelihood(x, moves, start):
        total = 0.0
        for c, n in enumerate(mask.sum(axis=0)):
            def value(tags, c=c):
                return start * tags[0] + sum(x[t, c] * k for t, k in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:]))

            every = [value([(code >> t) & 1 for t in range(n)]) for code in range(2**n)]
            total += value(y[:n, c].tolist()) - math.log(sum(map(math.exp, every)))
        return total

    gx, gm, gs = toxicity._gradients(x, y, mask, moves, start)
    eps = 1e-6
    for index in np.ndindex(2, 2):
        up = moves.copy()
        up[index] += eps
        assert gm[index] == pytest.approx((likelihood(x, up, start) - likelihood(x, moves, start)) / eps, abs=1e-4)
    assert gs == pytest.approx((likelihood(x, moves, start + eps) - likelihood(x, moves, start)) / eps, abs=1e-4)
    for index in ((0, 0), (2, 2), (3, 1)):
        up = x.copy()
        up[index] += eps
        assert gx[index] == pytest.approx((likelihood(up, moves, start) - likelihood(x, moves, start)) / eps, abs=1e-4)


def test_spans_are_offsets_of_the_original_text(spark):
    model = toxicity.Field({"=idiot": 12.0}, np.array([[1.0, -3.0], [0.0, -3.0]]), -3.0)
    texts = [(1, "You IDIOT idiot, Idiot! fine."), (2, "É idiot"), (3, "İ idiot"), (4, "fine")]
    got = {r["doc_id"]: r["spans"] for r in toxicity.score(docs_of(spark, texts), model).collect()}
    assert got == {1: "4:22", 2: "2:7", 3: "2:7", 4: ""}


# pipeline ------------------------------------------------------------------------------------------------------------


def test_stages_keep_columns_and_take_odd_tables(spark, tmp_path):
    rows = [(i, f"text {i} has its own words {i * 7}") for i in range(20)] + [(30, None), (31, ""), (None, "no id here"), (3, "text 3 has its own words 21")]
    rows += [(40, "token = \"abcdefghijklmnop\" stays here")]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            assert (out.count() == 0) == (table.count() == 0)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the null text and the empty one are equal, and the repeated row goes
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter([*range(20), 30, None, 40])


@needs_data
def test_pipeline_drops_what_its_stages_find(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    clean = {r["doc_id"]: r["text"] for r in toxic.select("doc_id", "text").collect()}
    groups = defaultdict(list)
    for i, t in clean.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    once = {min(g)[1] for g in groups.values()}
    exact = corpus_pipeline.drop_exact_copies(spark, toxic, FOLDER)
    assert {r["doc_id"] for r in exact.collect()} == once
    rows = [(i, clean[i]) for i in sorted(once)]
    _, want = near_want(rows, 5, 80)
    near = corpus_pipeline.drop_near_copies(spark, exact, FOLDER)
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in want.items() if i == c}


def test_near_stage_judges_rows_that_share_an_id(spark):
    """A clean row with the id of a near copy stays, and of near copies with one id one stays."""
    base = [f"w{k}" for k in range(200)]
    near = base[:-1] + ["other"]
    clean = [f"c{k}" for k in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (2, " ".join(clean)), (3, " ".join(f"d{k}" for k in range(90))), (None, " ".join(base))]
    rows += [(4, " ".join(f"e{k}" for k in range(100))), (4, " ".join([*(f"e{k}" for k in range(99)), "x"]))]
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), FOLDER).collect()]
    assert sorted(i for i, _ in left if i is not None) == [1, 2, 3, 4] and len(left) == 5
    assert (2, " ".join(clean)) in left


@pytest.mark.parametrize("most", [25, 8])
def test_a_sieve_loses_no_key_and_lets_few_others_through(spark, monkeypatch, most):
    monkeypatch.setattr("fourclocks.llm.common.SIEVE", most)
    key = F.when(F.col("id") % 10 != 7, F.struct("id", (F.col("id") * 3).alias("n"))).alias("key")
    rows = spark.range(40_000).select(key, F.lit("hit me").alias("text"))
    keys = spark.range(0, 40_000, 50).select(key)
    got = sieve(rows, keys, "key")
    assert got.columns == ["key", "text", "hit"] and got.count() == 40_000
    hit = [r[0]["id"] if r[0] else None for r in got.where("hit").select("key").collect()]
    assert {*range(0, 40_000, 50)} <= {*hit} and None not in hit
    assert len(hit) < 3600 or most == 8  # a sixteenth of the others where the bits suffice
    assert not sieve(rows, keys.limit(0), "key").where("hit").count()


def test_near_stage_leaves_texts_without_candidates_where_they_are(spark, monkeypatch):
    """Of 500 documents with two near copies only a few are dealt out, and tables of texts take less disk than the texts."""
    rng = random.Random(3)
    words = ["".join(rng.choices("aeiorstlnmcdu", k=rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(500)]
    rows = [*enumerate(texts), (500, texts[3] + " more"), (501, texts[4] + " more")]
    shuffled = []

    def seen(*args):
        out = sieve(*args)
        shuffled.append(out.where("hit").count())
        return out

    monkeypatch.setattr(corpus_pipeline, "sieve", seen)
    monkeypatch.setattr(minhash, "sieve", seen)
    left = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), FOLDER)
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(500)]
    assert len(shuffled) == 2 and 4 <= shuffled[0] < 60 and 2 <= shuffled[1] < 60
    exact = corpus_pipeline.drop_exact_copies(spark, docs_of(spark, rows), FOLDER)
    assert exact.count() == 502
    folder = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    for name in ("numbered", "sorted"):
        newest = max((f for f in os.listdir(folder) if f.startswith(name)), key=lambda f: os.path.getmtime(f"{folder}/{f}"))
        parts = [f"{folder}/{newest}/{f}" for f in os.listdir(f"{folder}/{newest}") if f.endswith(".parquet")]
        assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in parts if pq.ParquetFile(f).metadata.num_rows} == {"ZSTD"}
