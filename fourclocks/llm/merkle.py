"""Merkle manifest of a dataset, checked by a recursive climb.

Every row is a leaf. Leaves ascend by id inside their group; pairs are hashed level by level to the group's subroot, and
the subroots, ordered by group, to the root. Levels are built ``STRIDES`` at a time and stored as node rows: a node's row
holds the siblings on its way up to an ancestor several levels above and a link to that ancestor's row; the last link of a
group goes up to the root. A recursive query starts at the leaves, follows the links, appends the siblings and folds a
possibly tampered leaf hash with them.

Rows of upper nodes are stored once for each lane of neighbouring leaves (the leaves below one node of the first link), so no
join key of the climb holds more leaves than that, whatever the size of a group; the copies are a small share of the leaves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fourclocks.llm.common import keep

#: Levels between two stored links: of the leaves, and of the nodes above. A lane is the leaves below one first link.
STRIDES = (12, 6)

_UPS = T.StructType(
    [
        T.StructField("top", T.BinaryType()),
        T.StructField("ups", T.ArrayType(T.ArrayType(T.BinaryType()))),
    ]
)


def record_hash(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def parent(hashes: Sequence[bytes]) -> bytes:
    """The hash of a run of one or two nodes: sha256 of their hex texts."""
    return hashlib.sha256("".join(h.hex() for h in hashes).encode()).digest()


def climb_block(hashes: Sequence[bytes], size: int, stride: int) -> tuple[bytes, list[list[bytes | None]]]:
    """The top of a block of at most ``2 ** stride`` nodes, and for each node its siblings on the way there.

    ``size`` is the number of nodes on the block's level in the whole tree: a level with one node is the last one. A node
    that is alone in its run has the sibling None.
    """
    level, ups = list(hashes), [[] for _ in hashes]
    for k in range(stride):
        if size <= 1:
            break
        for i, way in enumerate(ups):
            other = (i >> k) ^ 1
            way.append(level[other] if other < len(level) else None)
        level = [parent(level[j : j + 2]) for j in range(0, len(level), 2)]
        size = -(-size // 2)
    return level[0], ups


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add pos (from 0, by ``order``) inside the group, and leaves, the group's row count. Nulls come first.

    One range-partitioned sort; a window runs over one row for each group and partition of the sort only.
    """
    keys = [group, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = keep(dealt.withColumn("_n", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_n", 33)
    counted = ordered.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_group")
    offsets = counted.select(
        "_group", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("leaves")
    )
    same = F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part"))
    return ordered.join(offsets, same).withColumn("pos", F.col("_n") + F.col("_shift")).drop("_n", "_group", "_part", "_shift")


def _blocks(rows: DataFrame, stride: int, extra: Sequence[str], size: Column, name: str) -> DataFrame:
    """Blocks of ``2 ** stride`` neighbouring nodes with their top and each node's siblings; no task holds more of a group."""

    def climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes = (batch.column(batch.schema.get_field_index(c)) for c in ("items", "size"))
            for k in range(batch.num_rows):
                hashes = items.slice(k, 1).flatten().field("hash").to_pylist()
                top, ways = climb_block(hashes, sizes[k].as_py(), stride)
                made = [pa.array([top], pa.binary()), pa.array([ways], pa.list_(pa.list_(pa.binary())))]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *made], names=[*batch.schema.names, "top", "ups"])

    item = F.struct("pos", "hash", *extra)
    blocks = rows.groupBy("tree", "leaves", F.shiftright("pos", stride).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    blocks = blocks.withColumn("size", size)
    return keep(blocks.mapInArrow(climbed, T.StructType([*blocks.schema.fields, *_UPS.fields])), name)


def build(leaves: DataFrame, payload: Sequence[str]) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Leaves with their first links, the node rows above them (None: there are none), and the tops (tree, hash).

    leaves: tree, pos, leaves (of the tree), hash and ``payload``. Links carry at (place on their level), up (siblings) and
    next (the step of the link that follows; null where the top is reached).
    """
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    level, extra, step, below = leaves, list(payload), 0, 0
    first = nodes = tops = None
    while True:
        stride = STRIDES[min(step, 1)]
        size = F.ceil(F.col("leaves") / F.lit(float(1 << below))).cast("long")  # nodes of this level in the tree
        done = _blocks(level, stride, extra, size, f"level-{step}")
        ended = F.col("size") <= 1 << stride
        rows = done.select("tree", "leaves", F.when(~ended, step + 1).alias("next"), F.explode(F.arrays_zip("items", "ups")).alias("z")).select(
            "tree", "leaves", "next", F.col("z.items.pos").alias("at"), F.col("z.ups").alias("up"), *[F.col("z.items")[c].alias(c) for c in ["hash", *extra]]
        )
        if step == 0:
            first = rows
        else:
            # one copy for each lane below the node
            wide = below - STRIDES[0]
            lanes = F.sequence(F.shiftleft("at", wide), F.least(F.shiftleft(F.col("at") + 1, wide) - 1, F.shiftright(F.col("leaves") - 1, STRIDES[0])))
            shelf = rows.select("tree", F.lit(step).alias("step"), F.explode(lanes).alias("lane"), "at", "up", "next")
            nodes = shelf if nodes is None else nodes.unionByName(shelf)
        here = done.where(ended).select("tree", F.col("top").alias("hash"))
        tops = here if tops is None else tops.unionByName(here)
        below += stride
        if most <= 1 << below:
            return first, nodes, tops
        level = done.where(~ended).select("tree", "leaves", F.col("block").alias("pos"), F.col("top").alias("hash"))
        extra, step = [], step + 1


def roofed(links: DataFrame, ways: DataFrame) -> DataFrame:
    """Last links of a tree go on up to the root: siblings and place of the subroot are put behind their own."""
    last = F.col("next").isNull()
    joined = links.join(ways, "tree")
    return joined.select(
        *[c for c in links.columns if c not in ("at", "up")],
        F.when(last, F.col("at") + F.expr("shiftleft(tree, size(up))")).otherwise(F.col("at")).alias("at"),
        F.when(last, F.concat("up", "way")).otherwise(F.col("up")).alias("up"),
        F.when(last, F.col("subroot")).alias("subroot"),
    )


@contextmanager
def _no_row_limit(spark: SparkSession):
    """Recursive queries may return as many rows as there are leaves and levels while this holds."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fold(up: str, start: str, at: str) -> str:
    """SQL: hash ``start`` with the siblings ``up``; the bits of ``at`` say on which side the node stands."""
    return f"""aggregate(transform({up}, (s, i) -> named_struct('s', lower(hex(s)), 'second', shiftright({at}, i) % 2 = 1)), {start},
      (acc, u) -> unhex(sha2(concat(if(u.second, u.s, ''), lower(hex(acc)), if(u.second, '', coalesce(u.s, ''))), 256)))"""


def _flat(up: str) -> str:
    """SQL: the siblings one after the other, without those that are absent."""
    return f"aggregate({up}, CAST('' AS BINARY), (acc, s) -> concat(acc, coalesce(s, CAST('' AS BINARY))))"


def climb(spark: SparkSession, first: DataFrame, nodes: DataFrame | None, payload: Sequence[str], name: str, flat: bool) -> DataFrame:
    """Every leaf's way to the last link: ``payload``, tree, folded, path (``flat``: proof, its hash) and subroot.

    ``first`` has ``start``, the hash to fold, and ``place``; both tables have subroot (of last links). The path holds the
    siblings: with ``flat`` as one run of bytes, else as a list with null where there is none. The recursive query runs once,
    into a table.
    """
    tag = uuid.uuid4().hex
    empty = "tree long, step int, lane long, at long, up array<binary>, next int, subroot binary"
    views = {f"leaf_{tag}": first, f"node_{tag}": spark.createDataFrame([], empty) if nodes is None else nodes}
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    own = ", ".join(f"`{c}`" for c in payload)
    shown = _flat if flat else str
    sql = f"""
WITH RECURSIVE climb AS (
  SELECT {own}, tree, shiftright(place, {STRIDES[0]}) AS lane, next AS step, {_fold("up", "start", "at")} AS folded, {shown("up")} AS path, subroot
  FROM leaf_{tag}
  UNION ALL
  SELECT {", ".join(f"c.`{c}`" for c in payload)}, c.tree, c.lane, n.next, {_fold("n.up", "c.folded", "n.at")}, concat(c.path, {shown("n.up")}), n.subroot
  FROM climb c JOIN node_{tag} n ON n.tree = c.tree AND n.step = c.step AND n.lane = c.lane
)
SELECT {own}, tree, folded, {"sha2(lower(hex(path)), 256) AS proof" if flat else "path"}, subroot FROM climb WHERE step IS NULL"""
    try:
        with _no_row_limit(spark):
            return keep(spark.sql(sql), name)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


def manifest(docs: DataFrame, leaf: Column, altered: Column, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """Per row: the id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``leaf`` is the hex hash of a row and ``altered`` the one to be checked (null: the leaf itself); ``folded_root`` is what
    the original siblings make of it. Groups order by their UTF-8 bytes, null first; leaves by id, null first, then by leaf
    hash; repeated rows are leaves of their own. A lone leaf is its group's subroot, a lone subroot the root, and its proof
    is the hash of nothing. Other columns are ignored, so their names cannot clash; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    # which row comes first among equal ids is settled by the leaf hash; equal rows are interchangeable
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), F.unhex(leaf).alias("hash"), F.unhex(altered).alias("altered"), F.monotonically_increasing_id().alias("row")
    )
    placed = positions(keep(rows, "leaves"), "group", ["id", "hash", "row"])
    groups = placed.groupBy("group").agg(F.first("leaves").alias("n")).withColumn("all", F.lit(0))
    trees = keep(positions(keep(groups, "groups"), "all", ["group"]).select("group", F.col("pos").alias("tree"), F.col("leaves").alias("trees")), "trees")
    named = trees.select(F.col("group").alias("_group"), "tree")
    own = placed.join(named, F.col("group").eqNullSafe(F.col("_group"))).select(
        "tree", "pos", "leaves", "hash", "id", F.coalesce("altered", "hash").alias("start")
    )
    out = T.StructType([T.StructField(id_col, rows.schema["id"].dataType)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())])
    if trees.isEmpty():
        return spark.createDataFrame([], out)
    first, nodes, tops = build(keep(own, "placed"), ["id", "start"])
    subroots = keep(tops, "subroots")
    # the way from each subroot to the root, by the same climb one storey higher
    higher = subroots.crossJoin(F.broadcast(trees.agg(F.max("trees").alias("n")))).select(  # one row
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("n").alias("leaves"), "hash", F.col("hash").alias("start")
    )
    none = F.lit(None).cast("binary").alias("subroot")
    top_first, top_nodes, top = build(higher, ["start"])
    top_first = top_first.select("*", F.col("at").alias("place"), none)
    ways = climb(spark, top_first, None if top_nodes is None else top_nodes.select("*", none), ["place", "start"], "ways", flat=False)
    ways = ways.select(F.col("place").alias("tree"), F.col("path").alias("way"), F.col("start").alias("subroot"))
    root = top.first()["hash"].hex()
    first = roofed(first.withColumn("place", F.col("at")), ways)
    done = climb(spark, first, None if nodes is None else keep(roofed(nodes, ways), "nodes"), ["id", "hash"], "climbed", flat=True)

    def text(column: str) -> Column:
        return F.lower(F.hex(column))

    folded = text("folded")
    return done.select(
        F.col("id").alias(id_col),
        text("hash").alias("leaf"),
        text("subroot").alias("subroot"),
        F.lit(root).alias("root"),
        F.col("proof").alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == F.lit(root)).alias("verified"),
    )
