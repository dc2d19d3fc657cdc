"""The prefix trie of conversations by truncation peeling.

Conversations descend together: at the deepest level those that end there are grouped by their whole
path, then the last turn of every path is stripped and what is left regrouped together with the
conversations that end one level higher, down to the root. A group is a node; counts, least member,
leaves and saved bytes are summed while it is found, so each level is one aggregation of the nodes
below it. Equal conversations merge before the first level, and sums merge before every shuffle, so
neither the root nor a first turn that a third of all conversations share is a hot group.

A turn that only one conversation reaches is a node of its own, and so are all after it. Such a tail needs
no regrouping: it is cut off where it leaves the last shared node, and its nodes are emitted as rows.
So the number of levels is the greatest depth that two conversations share, not the longest
conversation, and only paths of shared turns are arrays.

Turns travel as digests: a node is the MD5 chain of (role, text) from the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlines.functions.storage import materialize

#: Conversations c to c + FAMILY - 1 share the head of the first, of at most HEADS - 1 turns.
FAMILY = 5
HEADS = 9
#: Conversation ids of one block of a digest, by their high bits.
BLOCK_BITS = 12
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()


def head_turns(conv: str = "conv_id") -> Column:
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, pos from 1, digest, bytes) by turn, null first, ties by role and text.

    Null role and text are empty. Rows without conv_id take no part.
    """
    empty = F.lit("")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    told = F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")
    turns = turns.select(
        "conv_id", "turn", F.unhex(F.md5(told.cast("binary"))).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "bytes")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of their family's first: (conv_id, pos, digest, bytes), and all ids.

    The first h turns come from conversation c - c % 5, the rest are c's own after its first h; h is the
    crc32 of the id modulo 9. A conversation may end up without turns. Heads are arrays of at most
    8 turns and go to at most 9 conversations.
    """
    own = materialize(ordered_turns(conversations), "turns")
    in_head = F.col("pos") < HEADS
    convs = own.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(in_head, F.struct("pos", "digest", "bytes")))).alias("turns")
    )
    convs = convs.withColumn("h", head_turns())
    heads = convs.select(F.col("conv_id").alias("base"), "turns")
    wanted = convs.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    kept = F.filter("turns", lambda turn: turn["pos"] <= F.col("h"))
    none = F.array().cast(heads.schema["turns"].dataType)
    built = wanted.join(heads, "base", "left").select("conv_id", "h", F.coalesce(kept, none).alias("head"))
    built = materialize(built, "heads")
    of_head = built.select("conv_id", F.inline("head"))
    tail = own.join(built.select("conv_id", "h", F.size("head").alias("lead")), "conv_id").where("pos > h")
    of_tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "bytes")
    return of_head.unionByName(of_tail), built.select("conv_id")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the turns of whole conversations that come in order."""
    conv, node = None, ROOT
    for batch in batches:
        nodes, parents = [], []
        for current, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist()):
            if current != conv:
                conv, node = current, ROOT
            parents.append(node)
            node = hashlib.md5(node + digest).digest()
            nodes.append(node)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("pos"), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column("bytes")],
            ["conv_id", "pos", "node", "parent", "bytes"],
        )


def chained_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, node, parent, bytes): the node that each turn reaches."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(_chain, "conv_id long, pos long, node binary, parent binary, bytes long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined blocks of each node; blocks come in order, one state is open at a time."""
    node, state = None, None
    for batch in batches:
        nodes, found = [], []
        for current, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if current != node:
                if state is not None:
                    nodes.append(node)
                    found.append(state.hexdigest())
                node, state = current, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found, pa.string())], ["node", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256) of the ids (node, conv_id), ascending and comma-joined.

    Ids are joined in blocks of a fixed id range first, so the task that follows the order of a node reads one
    row per block, streams it and holds none.
    """
    blocks = (
        ends.groupBy("node", F.shiftright("conv_id", BLOCK_BITS).alias("block"))
        .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
        .select("node", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    )
    ordered = blocks.repartition("node").sortWithinPartitions("node", "block")
    return ordered.select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")


def _level(found: DataFrame, depth: int) -> DataFrame:
    """Nodes of one depth from what ends at them or was stripped to them."""
    nodes = found.groupBy("node").agg(
        F.any_value("path").alias("path"),
        F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    last = F.coalesce(F.try_element_at("path", F.lit(-1))["bytes"], F.lit(0))
    return nodes.select(
        "node", "path", F.lit(depth).cast("long").alias("depth"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).alias("saved_tokens"),
    )


def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes as contributions to their parents: the last turn of the path goes."""
    path = F.slice("path", F.lit(1), F.size("path") - 1)
    return nodes.select(
        F.coalesce(F.try_element_at(path, F.lit(-1))["node"], F.lit(ROOT)).alias("node"), path.alias("path"),
        "n_convs", "conv_id", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations that are empty once rebuilt end at the root. A table without conversations has no
    nodes. Repeated rows are turns of their own.
    """
    turns, ids = rebuilt_turns(conversations)
    turns = materialize(chained_turns(turns), "chained-turns")
    shared = materialize(
        turns.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "shared-nodes"
    )
    common = turns.join(shared, "node", "left_semi")
    private = turns.join(shared, "node", "left_anti")
    paths = common.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "bytes"))).alias("path"))
    tails = private.groupBy("conv_id").agg(F.max("pos").alias("end"))
    stems = ids.join(paths, "conv_id", "left").join(tails, "conv_id", "left").select(
        "conv_id", F.coalesce("path", F.array().cast(paths.schema["path"].dataType)).alias("path"), F.col("end").isNotNull().alias("goes_on"),
    )
    reached = F.coalesce(F.try_element_at("path", F.lit(-1))["node"], F.lit(ROOT))
    stems = materialize(stems.withColumn("node", reached), "stems")
    merged = materialize(
        stems.groupBy("node").agg(
            F.any_value("path").alias("path"),
            F.count(F.lit(1)).alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.count_if("goes_on").alias("n_children"),
        ).withColumns({"n_leaves": F.col("n_children"), "saved_tokens": F.lit(0).cast("long")}),
        "ends",
    )
    deepest = merged.agg(F.max(F.size("path"))).first()[0]
    levels: list[DataFrame] = []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        found = merged.where(F.size("path") == depth)
        if levels:
            found = found.unionByName(_stripped(levels[-1]))
        levels.append(materialize(_level(found, depth), f"depth-{depth}"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    nodes = private.join(tails, "conv_id").select(
        "node", "parent", F.col("pos").alias("depth"), "conv_id", one.alias("n_convs"),
        (F.col("pos") < F.col("end")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
    )
    parents = nodes.select("parent", F.col("conv_id").alias("shared_parent")).where(F.lit(False))
    for level in levels:
        above = F.coalesce(F.try_element_at("path", F.lit(-2))["node"], F.lit(ROOT))
        parent = F.when(F.col("depth") > 0, above).alias("parent")
        nodes = nodes.unionByName(level.select(parent, *[c for c in nodes.columns if c != "parent"]))
        parents = parents.unionByName(level.select(F.col("node").alias("parent"), F.col("conv_id").alias("shared_parent")))
    ended = ends_digests(stems.where("NOT goes_on").select("node", "conv_id"))
    # A private node without children is where its only conversation ends; with a private parent both are its own.
    alone = (F.col("n_convs") == 1) & (F.col("n_children") == 0)
    return (
        nodes.join(ended, "node", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id", "depth",
            F.when(F.col("depth") > 0, F.coalesce("shared_parent", "conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce(
                "ends_sha256", F.when(alone, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)), F.lit(NOTHING)
            ).alias("ends_sha256"),
        )
    )
