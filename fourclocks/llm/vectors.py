"""Embedding near-duplicates by searching robust-pruned flat graphs.

Equal vectors are one node. Nodes go to overlapping shards around k-means centres, split again while a shard is too
large for one task. Each shard builds a graph whose neighbour lists are robustly pruned; a node's lists from all its
shards are united. In every shard a greedy search starts at the medoid for each member and, once inside the range,
expands until no unvisited neighbour is in range. Its pairs, confirmed in double precision, only join components; the
links inside a component are then counted over all pairs of its blocks, so no shard bounds them. Recall is audited against
brute force; a search below the target is repeated with more overlap and wider lists, and at last all blocks meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fourclocks.llm.common import components, keep


@dataclass(frozen=True)
class Search:
    """Parameters. ``shard``: nodes of a shard; ``overlap``: shards of a node; ``degree``, ``pool``: kept and weighed
    neighbours; ``alpha``: pruning slack; ``width``: nodes that a search expands at least; ``slack``: how far below the
    threshold a search still expands; ``sample``: vectors for fitting centres; ``chunk``: nodes dealt to centres together;
    ``audit``: audited queries, or twice the root of the nodes where that is more; ``block``: nodes of a group that meet another block's in one task."""

    shard: int = 1200
    overlap: int = 3
    degree: int = 20
    pool: int = 48
    alpha: float = 1.2
    width: int = 24
    slack: float = 0.03
    sample: int = 8192
    chunk: int = 4096
    audit: int = 128
    block: int = 2048
    target: float = 0.98


def unit(rows: list) -> np.ndarray:
    """Rows as unit vectors in double precision; finite floats cannot overflow when scaled by their largest part first."""
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector, copies): usable vectors, equal ones as one node under their smallest id."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(fine).groupBy(F.col("v").alias("vector")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def centres(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample, started at rows spread over it."""
    rng = np.random.default_rng(7)
    chosen = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ chosen.T).argmax(axis=1)
        total = np.zeros_like(chosen)
        np.add.at(total, near, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        chosen = np.where(size > 0, total / np.where(size > 0, size, 1), chosen)
    return chosen


def shards(of: DataFrame, search: Search) -> DataFrame:
    """(shard, id, vector): every node in ``overlap`` shards of about ``search.shard`` nodes at most, near its vector.

    A shard that is too large is split by centres of its own bounded sample. The first split makes ``overlap`` copies of
    a node; a later one looks at the children of all its large shards together and keeps as many of the nearest as it
    had large shards, so the copies do not multiply with the levels. Vectors of other lengths never meet. Directions that
    no centre tells apart stay together after six levels; ``find_links`` searches such a shard in blocks.
    """
    kind = of.schema["id"].dataType.simpleString()
    element = of.schema["vector"].dataType.simpleString()
    done, rows = None, of.select(F.concat(F.lit("d"), F.size("vector").cast("string")).alias("shard"), "id", "vector")
    for level in range(6):
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n"))
        rows = rows.join(sizes, "shard")
        small = rows.where(F.col("n") <= search.shard) if level < 5 else rows
        small = small.select("shard", "id", "vector")
        done = small if done is None else done.unionByName(small)
        large = rows.where(F.col("n") > search.shard)
        if level == 5 or large.isEmpty():
            break
        # fit: at most ``search.sample`` vectors of a shard, drawn by id hash
        take = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) * F.col("n").cast("double") <= F.lit(float((search.sample // 2) << 30))
        copies = 1.6 * (search.overlap if level == 0 else 1)

        def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id").head(search.sample)
            x, n = unit(frame["vector"].tolist()), int(frame["n"].iloc[0])
            count = int(min(512, max(2, math.ceil(copies * n / search.shard)), len(x)))
            return pd.DataFrame({"shard": [key[0]], "n": [n], "centres": [pa_list(centres(x, count))]})

        fitted = large.where(take).select("shard", "id", "vector", "n").groupBy("shard").applyInPandas(fit, "shard string, n long, centres array<array<double>>")
        fitted = keep(fitted, "centres")

        def assign(frame: pd.DataFrame, fit_of: pd.DataFrame) -> pd.DataFrame:
            if frame.empty:
                return pd.DataFrame({"parent": [], "shard": [], "near": [], "id": [], "vector": []})
            near = unit(frame["vector"].tolist()) @ np.stack([np.stack(c) for c in fit_of["centres"]])[0].T
            best = np.argsort(-near, axis=1, kind="stable")[:, : search.overlap]
            at, parent = np.repeat(np.arange(len(frame)), best.shape[1]), frame["shard"].iloc[0]
            return pd.DataFrame(
                {
                    "parent": parent,
                    "shard": [f"{parent}.{c}" for c in best.ravel()],
                    "near": near[at, best.ravel()],
                    "id": frame["id"].to_numpy()[at],
                    "vector": frame["vector"].to_numpy()[at],
                }
            )

        # a chunk of a shard meets its centres once: no shard is one task, no row carries the centres
        chunks = F.ceil(F.col("n") / F.lit(search.chunk)).cast("int")
        members = large.select("shard", "id", "vector", F.pmod(F.xxhash64("id", F.lit(-1 - level)), chunks).cast("int").alias("chunk"))
        stars = fitted.select("shard", "centres", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        placed = members.groupBy("shard", "chunk").cogroup(stars.groupBy("shard", "chunk")).applyInPandas(
            assign, f"parent string, shard string, near double, id {kind}, vector {element}"
        )
        if level:
            nearest = F.sort_array(F.collect_list(F.struct("near", "shard")), asc=False)  # at most overlap squared entries
            each = placed.groupBy("id").agg(nearest.alias("all"), F.size(F.collect_set("parent")).alias("parents"), F.first("vector").alias("vector"))
            placed = each.select(F.explode(F.slice("all", F.lit(1), F.col("parents"))).alias("to"), "id", "vector").select("to.shard", "id", "vector")
        rows = keep(placed.select("shard", "id", "vector"), "assigned")
    return done


def pa_list(x: np.ndarray) -> list:
    return [row.tolist() for row in x]


def robust_graph(x: np.ndarray, search: Search) -> np.ndarray:
    """Neighbour lists (-1 fills up): from the nearest and some random candidates, keep the closest and drop those that
    a kept one reaches ``alpha`` times closer."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    near = min(search.pool, n - 1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    pool = np.argpartition(-s, near - 1, axis=1)[:, :near]
    if n > search.pool:
        far = np.random.default_rng(n).integers(0, n, (n, search.pool // 4))
        pool = np.concatenate([pool, far], axis=1)
    own = np.take_along_axis(s, pool, axis=1)
    own[pool == np.arange(n)[:, None]] = -2
    order = np.argsort(-own, axis=1, kind="stable")
    pool, own = np.take_along_axis(pool, order, axis=1), np.take_along_axis(own, order, axis=1)
    distance = np.sqrt(np.maximum(0, 2 - 2 * own))
    open_ = own > -2
    kept = np.full((n, search.degree), -1)
    rows = np.arange(n)
    for k in range(search.degree):
        has = open_.any(axis=1)
        if not has.any():
            break
        first = open_.argmax(axis=1)
        star = pool[rows, first]
        kept[has, k] = star[has]
        between = np.sqrt(np.maximum(0, 2 - 2 * s[star[:, None], pool]))
        between[star[:, None] == pool] = 0
        open_ &= (search.alpha * between > distance) & has[:, None]
    return kept


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray, strip: int = 1 << 15) -> np.ndarray:
    """Dot products of row pairs; rows are gathered in strips, so memory does not grow with pairs times dimensions."""
    out = np.empty(len(i))
    for at in range(0, len(i), strip):
        part = slice(at, at + strip)
        out[part] = np.einsum("pd,pd->p", x[i[part]], x[j[part]])
    return out


def range_search(x: np.ndarray, first: np.ndarray, flat: np.ndarray, threshold: float, search: Search) -> np.ndarray:
    """Pairs (i, j), i < j, found by a greedy search for each row from the medoid, expanding everything near the range.

    A search that ends without having met its own row has not come to the right place; it goes on from that row. The neighbours of node i are ``flat[first[i]:first[i + 1]]``; a similarity is computed when a search first meets a node.
    """
    n = len(x)
    if n < 2:
        return np.empty((0, 2), np.int64)
    medoid = int((x @ x.mean(axis=0)).argmax())
    seen = np.full((n, n), -3.0, np.float32)  # similarity of visited nodes, -3 unvisited
    fresh = np.full((n, n), -3.0, np.float32)  # the same, for nodes not expanded yet
    start = (x @ x[medoid]).astype(np.float32)
    seen[:, medoid] = fresh[:, medoid] = start
    degree = np.diff(first)
    live, turn, again = np.arange(n), 0, False
    while True:
        if not len(live):
            lost = np.flatnonzero(seen[np.arange(n), np.arange(n)] == -3)
            if again or not len(lost):
                break
            seen[lost, lost] = fresh[lost, lost] = 1
            live, turn, again = lost, 0, True
        best = fresh[live].argmax(axis=1)
        value = fresh[live, best]
        go = (value > -3) & ((turn < search.width) | (value >= threshold - search.slack))
        live, best = live[go], best[go]
        if not len(live):
            continue
        fresh[live, best] = -3
        ends = np.cumsum(degree[best])
        q = np.repeat(live, degree[best])
        node = flat[np.arange(len(q)) + np.repeat(first[best] - ends + degree[best], degree[best])]
        new = seen[q, node] == -3
        q, node = q[new], node[new]
        seen[q, node] = fresh[q, node] = cosines(x, q, node)
        turn += 1
    i, j = np.nonzero(seen >= threshold - 1e-4)
    pairs = np.unique(np.minimum(i, j)[i != j] * n + np.maximum(i, j)[i != j])
    i, j = pairs // n, pairs % n
    linked = cosines(x, i, j) >= threshold
    return np.stack([i[linked], j[linked]], axis=1)


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """(root, node) for every node that pairs (i, j) join to a smaller one: what they connect, in fewer than ``n`` rows."""
    label = np.arange(n)
    i, j = pairs[:, 0], pairs[:, 1]
    while True:
        before, low = label.copy(), np.minimum(label[i], label[j])
        for at in (label[i], label[j], i, j):
            np.minimum.at(label, at, low)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label < np.arange(n))
    return np.stack([label[node], node], axis=1)


def by_task(sharded: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Shards of at most ``most`` nodes, which are one task, and larger ones as (group, id, vector)."""
    sizes = sharded.groupBy("shard").agg(F.count("*").alias("n"))
    rows = sharded.join(sizes, "shard")
    large = rows.where(F.col("n") > most).select(F.col("shard").alias("group"), "id", "vector")
    return rows.where(F.col("n") <= most).drop("n"), large


def find_links(of: DataFrame, threshold: float, search: Search) -> DataFrame:
    """(a, b) ids with a < b that are joined by confirmed pairs of a shard; fewer rows than the shards have."""
    kind = of.schema["id"].dataType.simpleString()
    sharded, large = by_task(keep(shards(of, search), "shards"), search.shard)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        ids = frame["id"].to_numpy()
        kept = robust_graph(unit(frame["vector"].tolist()), search)
        source, target = np.repeat(np.arange(len(ids)), kept.shape[1])[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
        both = pd.DataFrame({"id": np.r_[source, target], "to": np.r_[target, source]})  # edges lead both ways
        lists = both.groupby("id")["to"].apply(lambda t: ids[np.unique(t)].tolist())
        return pd.DataFrame({"id": ids[lists.index.to_numpy(np.int64)], "near": pd.Series(lists.to_list(), dtype=object)})  # a lone node has no row

    adjacency = sharded.groupBy("shard").applyInPandas(build, f"id {kind}, near array<{kind}>")
    united = keep(adjacency.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        ids = frame["id"].to_numpy()
        place = {v: i for i, v in enumerate(ids.tolist())}
        lists = [[place[t] for t in near if t in place] if near is not None else [] for near in frame["near"]]
        first = np.cumsum([0, *map(len, lists)])
        flat = np.array([t for own in lists for t in own], dtype=np.int64)
        pairs = range_search(unit(frame["vector"].tolist()), first, flat, threshold, search)
        links = forest(pairs, len(ids))
        return pd.DataFrame({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})

    found = sharded.join(united, "id", "left").groupBy("shard").applyInPandas(look, f"a {kind}, b {kind}")
    # what no centre could cut: its blocks meet, pair by pair
    met = partners(large.withColumn("copies", F.lit(1).cast("long")), threshold, search.block).where("root != id")
    return keep(found.unionByName(met.select(F.col("root").alias("a"), F.col("id").alias("b"))).distinct(), "links")


def partners(of: DataFrame, threshold: float, block: int, strip: int = 512) -> DataFrame:
    """(id, others, root) from all pairs of nodes (group, id, vector, copies) of one group, in parts to be summed per id.

    A group is cut into blocks of about ``block`` nodes by id hash; two blocks, or some groups of one block, are a task.
    ``others`` counts linked rows of the task, ``root`` is the smallest id the task joins the node to. A group of n nodes
    moves n * n / block rows and no pair leaves its task.
    """
    kind = of.schema["id"].dataType.simpleString()
    sized = of.join(of.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group")
    cut = F.ceil(F.col("n") / F.lit(block)).cast("int")
    total = sized.count()
    if not total:
        return of.sparkSession.createDataFrame([], f"id {kind}, others long, root {kind}")
    one = F.concat(F.lit("s"), F.pmod(F.xxhash64("group"), F.lit(max(1, math.ceil(total / block)))).cast("string"))
    own = F.pmod(F.xxhash64("id", F.lit(11)), cut).cast("int")
    met = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    name = F.when(cut == 1, one).otherwise(F.concat_ws(":", F.col("group").cast("string"), "lo", "hi"))
    met = met.select(name.alias("task"), "group", "lo", "hi", "own", "id", "vector", "copies")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", ignore_index=True)
        counts, roots = np.zeros(len(frame), np.int64), np.arange(len(frame))
        side, copies = frame["own"].to_numpy(), frame["copies"].to_numpy()
        same = bool(frame["lo"].iloc[0] == frame["hi"].iloc[0])
        for at in frame.groupby("group", sort=False).indices.values():
            x = unit(frame["vector"].iloc[at].tolist())
            left = np.arange(len(at)) if same else np.flatnonzero(side[at] == frame["lo"].iloc[0])
            right = left if same else np.flatnonzero(side[at] == frame["hi"].iloc[0])
            links = np.empty((0, 2), np.int64)
            for k in range(0, len(left), strip):
                some = left[k : k + strip]
                hit = x[some] @ x[right].T >= threshold
                if same:
                    hit[np.arange(len(some)), some] = False
                counts[at[some]] += hit @ copies[at[right]]
                if not same:
                    counts[at[right]] += copies[at[some]] @ hit
                i, j = np.nonzero(hit)
                links = forest(np.concatenate([links, np.stack([some[i], right[j]], axis=1)]), len(at))
            roots[at[links[:, 1]]] = at[links[:, 0]]
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"id": ids, "others": counts, "root": ids[roots]})

    return met.groupBy("task").applyInPandas(run, f"id {kind}, others long, root {kind}")


def audit(of: DataFrame, pairs: DataFrame, threshold: float, queries: int) -> tuple[int, int]:
    """(found, true) pairs of ``queries`` nodes of the smallest id hashes, against all nodes by brute force in blocks."""
    asked = of.orderBy(F.xxhash64("id", F.lit(3)), "id").select("id", "vector").limit(queries).collect()  # bounded
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for size in {len(r["vector"]) for r in asked}:
        own = [r for r in asked if len(r["vector"]) == size]
        by_size[size] = ([r["id"] for r in own], unit([r["vector"] for r in own]))
    kind = of.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = [], []
            ids, vectors = batch.column("id").to_pylist(), batch.column("vector").to_pylist()
            for size, (names, x) in by_size.items():
                mine = [i for i, v in enumerate(vectors) if len(v) == size]
                if mine:
                    for i, j in zip(*np.nonzero(unit([vectors[i] for i in mine]) @ x.T >= threshold)):
                        if ids[mine[i]] != names[j]:
                            one.append(min(ids[mine[i]], names[j]))
                            two.append(max(ids[mine[i]], names[j]))
            t = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(one, t), pa.array(two, t)], names=["a", "b"])

    true = keep(of.select("id", "vector").mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).distinct(), "audit")
    return true.join(pairs, ["a", "b"], "left_semi").count(), true.count()


def recall(of: DataFrame, member: DataFrame, threshold: float, queries: int) -> float:
    """Estimated share of the linked nodes' partners that share their component, inside which every pair is counted.

    Half of the queries are nodes with links, half are nodes without, where losses hide. Every query counts alike,
    whatever its number of partners, and a stratum counts by its nodes. Without any partner the recall is 1.
    """
    placed = of.join(member.select("id", "component"), "id", "left").select("id", "vector", F.coalesce("component", "id").alias("component"))
    placed = keep(placed.join(member.select("id", F.lit(True).alias("linked")), "id", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "audit")
    strata = [placed.where("linked"), placed.where("not linked")]
    asked = [s.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(max(1, queries // 2)).collect() for s in strata]  # bounded
    by_size: dict[int, list] = {}
    for r in asked[0] + asked[1]:
        by_size.setdefault(len(r["vector"]), []).append(r)
    parts = {size: ([r["id"] for r in rows], np.array([r["component"] for r in rows]), unit([r["vector"] for r in rows])) for size, rows in by_size.items()}
    kind = of.schema["id"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["vector"].map(len).to_numpy()
            for size, (names, groups, y) in parts.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    hit = unit(frame["vector"].iloc[at].tolist()) @ y.T >= threshold
                    hit &= frame["id"].to_numpy()[at][:, None] != np.array(names)
                    met = hit & (frame["component"].to_numpy()[at][:, None] == groups)
                    yield pd.DataFrame({"id": names, "met": met.sum(axis=0), "true": hit.sum(axis=0)}).query("true > 0")

    out = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("met long, true long")])
    tally = placed.select("id", "vector", "component").mapInPandas(run, out).groupBy("id").agg(F.sum("met").alias("met"), F.sum("true").alias("true"))
    shares = {r["id"]: r["met"] / r["true"] for r in tally.collect()}  # at most one row a query
    found = linked = 0.0
    for stratum, rows in zip(strata, asked):
        own = [shares[r["id"]] for r in rows if r["id"] in shares]
        if own:
            weight = stratum.count() / len(rows)
            found, linked = found + weight * sum(own), linked + weight * len(own)
    return found / linked if linked else 1.0


def near_vectors(
    table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", search: Search = Search(), attempts: int = 3
) -> DataFrame:
    """Per row: the id, n_links, component_id, kept.

    Vectors link where their cosine is ``threshold`` or more in double precision. A null, empty or zero vector, one with
    null or non-finite parts, or one without an id links with nothing; vectors of different lengths do not meet. Equal
    vectors are copies of each other and count as links. Ids must be unique for n_links to count rows. Other columns are
    ignored; an empty table gives an empty result.
    """
    of = keep(nodes(table, id_col, vector_col), "nodes")
    for attempt in range(attempts):
        member = keep(components(find_links(of, threshold, search)), "members")
        if recall(of, member, threshold, max(search.audit, math.ceil(2 * math.sqrt(of.count())))) >= search.target:
            break
        search = replace(search, overlap=search.overlap + 2, width=2 * search.width, slack=search.slack + 0.03)
    else:  # no search was good enough: every node meets every other
        whole = partners(of.withColumn("group", F.size("vector")), threshold, search.block)
        pairs = whole.where("root != id").select(F.col("root").alias("a"), F.col("id").alias("b"))
        member = keep(components(keep(pairs.distinct(), "links")), "members")
    inside = of.join(member.select("id", F.col("component").alias("group")), "id")
    linked = partners(inside, threshold, search.block).groupBy("id").agg(F.sum("others").alias("others"))
    per_node = of.join(linked, "id", "left").join(member, "id", "left").select(
        F.col("vector").alias("_vector"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    rows = table.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"))
    usable = F.col("_id").isNotNull()
    return rows.join(per_node, usable & (F.col("_v") == F.col("_vector")), "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "_id") == F.col("_id"), F.lit(True)).alias("kept"),
    )
