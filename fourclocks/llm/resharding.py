"""Resharding by minimum-cost flow.

Documents of an old shard fall into blocks (size classes). A flow from blocks to new shards whose capacities are row
counts, at a cost of a block's mean bytes for every row that leaves its shard, says how many rows of a block go where. Of a
block the smallest rows leave: whole ranges of sizes, and in the range where the cut falls those below an exact size, so the
bytes moved are the fewest that the capacities allow. The network has shards x classes nodes whatever the data; documents
meet it only as counts.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fourclocks.llm.common import whole_text

#: Size classes in halves of a power of two, ranges of sizes of a class, and what a lane of a range holds at most: so many rows,
#: and one such part of all rows.
CLASSES, RANGES, LANE, PART = 80, 32, 100_000, 1024


def min_cost_flow(supply: np.ndarray, home: np.ndarray, cost: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Rows of each block for each shard: all supplies placed, capacities met, the least total cost.

    Successive shortest paths. Every block starts at home, which costs nothing; overfull shards then push rows along
    cheapest paths, where a step from shard j to k moves the block that is cheapest to move. ``supply`` and
    ``capacity`` must have one sum.
    """
    shards = len(capacity)
    flow = np.zeros((len(supply), shards), np.int64)
    flow[np.arange(len(supply)), home] = supply
    price = np.where(np.arange(shards)[None, :] == home[:, None], 0.0, cost[:, None])
    load = flow.sum(axis=0)
    while (load > capacity).any():
        step = np.full((shards, shards), np.inf)
        block = np.zeros((shards, shards), np.int64)
        for j in range(shards):
            held = np.flatnonzero(flow[:, j])
            if len(held):
                change = price[held] - price[held, j][:, None]
                best = change.argmin(axis=0)
                step[j], block[j] = change[best, np.arange(shards)], held[best]
        np.fill_diagonal(step, np.inf)
        distance, before = np.where(load > capacity, 0.0, np.inf), np.full(shards, -1)
        for _ in range(shards):
            through = distance[:, None] + step
            best = through.argmin(axis=0)
            shorter = through[best, np.arange(shards)] < distance - 1e-9
            if not shorter.any():
                break
            distance = np.where(shorter, through[best, np.arange(shards)], distance)
            before = np.where(shorter, best, before)
        end = int(np.where(load < capacity, distance, np.inf).argmin())
        path, at = [], end
        while before[at] >= 0:
            path.append((int(before[at]), at))
            at = int(before[at])
        amount = min(int(load[at] - capacity[at]), int(capacity[end] - load[end]), *(int(flow[block[j, k], j]) for j, k in path))
        for j, k in path:
            flow[block[j, k], j] -= amount
            flow[block[j, k], k] += amount
        load[at] -= amount
        load[end] += amount
    return flow


def capacities(rows: int, shards: int, old: np.ndarray) -> np.ndarray:
    """Row counts at most one apart; the shards that hold most already take the odd rows. Old shards beyond ``shards`` get 0."""
    out = np.zeros(max(shards, len(old)), np.int64)
    out[:shards] = rows // shards
    held = np.zeros(shards, np.int64)
    held[: min(shards, len(old))] = old[:shards]
    out[np.argsort(-held, kind="stable")[: rows % shards]] += 1
    return out


def transfers(cells: list[tuple[int, int, int, int, int]], shards: int) -> tuple[dict[tuple[int, int], list[tuple[int, int]]], dict[tuple[int, int], tuple[int, int]]]:
    """From (old, class, range, rows, bytes): per block the (rows, shard) that it sends, those that stay last, and per block
    whose leavers end inside a range that range and how many of its rows leave."""
    groups: dict[tuple[int, int], list] = defaultdict(list)
    for old, kind, part, rows, size in sorted(cells):
        groups[old, kind].append((part, rows, size))
    blocks = sorted(groups)
    supply = np.array([sum(x[1] for x in groups[b]) for b in blocks], np.int64)
    cost = np.array([sum(x[2] for x in groups[b]) for b in blocks], float) / np.maximum(supply, 1)
    home = np.array([b[0] for b in blocks], np.int64)
    width = max(shards, int(home.max(initial=0)) + 1)
    old_rows = np.bincount(home, supply, minlength=width).astype(np.int64)
    flow = min_cost_flow(supply, home, cost, capacities(int(supply.sum()), shards, old_rows))
    sent, cuts = {}, {}
    for i, b in enumerate(blocks):
        leave = [(int(n), s) for s, n in enumerate(flow[i]) if n and s != home[i]]
        sent[b] = leave + ([(int(flow[i, home[i]]), int(home[i]))] if flow[i, home[i]] else [])
        left = sum(n for n, _ in leave)
        for part, rows, _ in groups[b]:
            if 0 < left < rows:
                cuts[b] = (part, left)
            left = max(0, left - rows)
    return sent, cuts


def limits(cuts: dict[tuple[int, int], tuple[int, int]], sizes: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], int]:
    """From (old, class, size, rows) of the cut ranges: per block the size at which its leavers end."""
    by_block: dict[tuple[int, int], list] = defaultdict(list)
    for old, kind, size, rows in sizes:
        by_block[old, kind].append((size, rows))
    out = {}
    for block, (_, left) in cuts.items():
        for size, rows in sorted(by_block[block]):
            if left <= rows:
                out[block] = size
                break
            left -= rows
    return out


def plan(sent: dict[tuple[int, int], list[tuple[int, int]]], counts: list[tuple[int, int, int, int, int, int]]) -> list[tuple]:
    """From (old, class, range, side, lane, rows): per group its (from rank, to rank, shard, first slot) segments. Groups of a
    block are served in order of size, so the first ones leave."""
    groups: dict[tuple[int, int], list] = defaultdict(list)
    for old, kind, part, side, lane, rows in sorted(counts):
        groups[old, kind].append((part, side, lane, rows))
    slots: dict[int, int] = defaultdict(int)
    out = []
    for b in sorted(groups):
        queue = list(sent[b])
        for part, side, lane, rows in groups[b]:
            at, segments = 0, []
            while at < rows:
                n, shard = queue[0]
                take = min(n, rows - at)
                segments.append((at, at + take, shard, slots[shard]))
                slots[shard] += take
                at += take
                queue[0] = (n - take, shard)
                if not queue[0][0]:
                    queue.pop(0)
            out.append((*b, part, side, lane, segments))
    return out


def reshard(docs: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """Place every row: id, size, text_crc32, law, shard, slot, grown_shard, old_shard, block, moved; with ``payload`` also the
    whole input row as ``row``.

    Law ``rows``: shard counts are at most one apart, slots gapless from 0. Size is the UTF-8 bytes of the text plus 1
    (null text: none). A null ``old_shard`` counts as shard 0; a null id is placed like any other; repeated rows get
    places of their own; other columns are ignored. An empty table gives an empty result.
    The driver sees one count for each old shard, class and range (at most shards x 80 x 32), the sizes of at most one range a
    block (a seventieth of the size itself), and some more counts (``PART``, and one for every ``LANE`` rows). Rows are ranked inside such a group;
    equal sizes are dealt over lanes by hash, so neither a hot shard nor a hot size is one group.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select(
        F.col(id_col).alias("_id"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if payload else []),
    ).select(
        "*",
        F.floor(2 * F.log2(F.col("size").cast("double"))).cast("int").alias("block"),
    )
    low = F.pow(F.lit(2.0), F.col("block") / 2)
    place = F.floor((F.col("size") / low - 1) / (2**0.5 - 1) * RANGES).cast("int")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), place)))
    block = ["old_shard", "block"]
    counted = [tuple(r) for r in rows.groupBy(*block, "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()]  # bounded: see above
    sent, cuts = transfers(counted, shards) if counted else ({}, {})
    kind = "old_shard int, block int, part int"
    ends: dict[tuple[int, int], int] = {}
    if cuts:
        cut = spark.createDataFrame([(*b, part) for b, (part, _) in cuts.items()], kind)
        found = rows.join(F.broadcast(cut), [*block, "part"]).groupBy(*block, "size").agg(F.count("*").alias("n")).collect()
        ends = limits(cuts, [tuple(r) for r in found])
    total = sum(c[3] for c in counted)
    cells = [(old, k, part, 1 + max(n // LANE, n * PART // total), ends.get((old, k)) if cuts.get((old, k), (None, 0))[0] == part else None) for old, k, part, n, _ in counted]
    cells_df = F.broadcast(spark.createDataFrame(cells, f"{kind}, lanes long, ends long"))  # at most shards x 80 x 32 rows
    side = F.coalesce(F.signum(F.col("size") - F.col("ends")).cast("int"), F.lit(0))
    lane = F.pmod(F.xxhash64("_id", "text_crc32"), F.col("lanes"))
    rows = rows.join(cells_df, [*block, "part"]).withColumns({"side": side, "lane": lane}).drop("lanes", "ends")
    keys = [*block, "part", "side", "lane"]
    made = plan(sent, [tuple(r) for r in rows.groupBy(*keys).agg(F.count("*").alias("n")).collect()])
    segments = spark.createDataFrame(made, f"{kind}, side int, lane long, segments array<struct<lo: long, hi: long, shard: int, slot: long>>")
    order = Window.partitionBy(*keys).orderBy("size", "_id", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    own = F.filter("segments", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0]
    return (
        ranked.join(segments, keys)
        .withColumn("_own", own)
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_own.shard").alias("shard"),
            (F.col("_own.slot") + F.col("_rank") - F.col("_own.lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "old_shard",
            "block",
            (F.col("_own.shard") != F.col("old_shard")).alias("moved"),
            *(["row"] if payload else []),
        )
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Write the files that the transfers touch and return what to do with every file of the layout.

    A file is a (shard, block) folder below ``path``. Those that lose or gain rows are written anew; the returned
    manifest (shard, block, action) says ``keep``, ``replace`` or, where nothing is left, ``drop``. Rows come from the payload
    of ``placed``, whatever their ids. Without a payload they are joined by id; null or repeated ids are then an error.
    """
    if "row" not in placed.columns:
        rows, ids = placed.agg(F.count("*"), F.count_distinct(id_col)).first()
        if rows != ids:
            raise ValueError(f"{rows} rows have {ids} different ids: place them with payload=True")
    before = placed.groupBy(F.col("old_shard").alias("shard"), "block").agg(F.max("moved").alias("lost"))
    after = placed.groupBy("shard", "block").agg(F.max("moved").alias("gained"))
    manifest = before.join(after, ["shard", "block"], "full").select(
        "shard",
        "block",
        F.when(F.col("gained").isNull(), "drop")
        .when(F.coalesce("lost", F.lit(True)) | F.col("gained"), "replace")
        .otherwise("keep")
        .alias("action"),
    )
    touched = F.broadcast(manifest.where("action = 'replace'").select("shard", "block"))  # at most shards x 80 rows
    clash = [c for c in ("shard", "block") if c in docs.columns]
    place = placed.join(touched, ["shard", "block"])
    if "row" in placed.columns:
        written = place.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in clash], "shard", "block")
    else:
        written = docs.drop(*clash).join(place.select(id_col, "shard", "block"), id_col)
    written.write.partitionBy("shard", "block").parquet(path)
    return manifest
