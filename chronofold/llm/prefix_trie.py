"""Trie of conversation prefixes by vertical bitmaps.

A conversation is a sequence of turns (role, text), ordered by turn number with nulls first; turns of
one number come in the order of a digest of role and text. A node of depth d is a distinct sequence of
first d turns, its members the conversations that begin with it. Turns are told apart by SHA-256 of
role and text; a node by its depth and 128 bits combined from the digests of its turns with their
positions.

1. *Tails.* Where a (position, turn) belongs to one conversation only, that conversation shares no
   node from there on. Such tails are nodes of one member and need no index.
2. *Shards.* The rest is cut by ranges of conversation ids and bands of positions. A shard indexes each
   (position, turn) as a bitset of its conversations and goes down depth first: the intersection of
   the parent's bitset with the posting of the lowest member's turn is a child, what is left over
   holds the others. Popcounts, smallest members, members and lists of conversations that end
   come out for each node of the shard.
3. *Merge.* Nodes of all shards are added up by their key; a node of very many members is one row a
   shard. Sums over subtrees go up along one conversation for each node, its smallest member.
   Lists of ends are ascending chunks of text, hashed one after the other as they stream by.

A conversation of very many turns is numbered across partitions and lies in bands of BAND positions.
Null role or text is empty. Rows with a null conversation id are left out; equal rows of one
conversation are turns of their own. An empty table has no nodes, not even a root. Very long texts are
read whole, once; only their digests and word counts travel. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.tables import written
from chronofold.plans.numbering import numbered

#: Conversation ids of a shard, and positions of a band.
SHARD, BAND = 1000, 64
_NODE = ("a", "b", "depth")
_EMPTY = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words``: every turn with its position from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        F.sha2(marked, 256).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    order = [F.asc_nulls_first("turn"), F.col("digest")]
    return numbered(turns, ["conv_id"], order, "pos").drop("turn")


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations (``conv_id, length``) after heads are shared in each family.

    Conversation c takes its first h = crc32(c) mod ``heads`` turns from c - c mod ``family`` and
    keeps its own from the h-th on.
    """
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % family
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own_length"))
    convs = lengths.select("conv_id", "own_length", own.alias("h"), base.alias("base"))
    giver = lengths.select(F.col("conv_id").alias("base"), F.col("own_length").alias("given"))
    head = F.least("h", F.coalesce("given", F.lit(0)))
    length = head + F.greatest(F.col("own_length") - F.col("h"), F.lit(0))
    convs = written(
        convs.join(giver, "base", "left").select(
            "conv_id", "h", "base", head.alias("head"), length.alias("length")
        ),
        "conversations",
    )
    theirs = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base")
    taken = convs.join(theirs, "base").where(F.col("pos") < F.col("h"))
    kept = turns.where(F.col("pos") >= own).join(convs.select("conv_id", "h", "head"), "conv_id")
    kept = kept.withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    columns = ("conv_id", "pos", "digest", "words")
    return kept.select(*columns).unionByName(taken.select(*columns)), convs.select("conv_id", "length")


def _lane(number: int) -> Column:
    """64 bits for a turn at its position."""
    digest = F.sha2(F.concat("digest", F.lit(":"), F.col("pos").cast("string")), 256)
    part = F.substring(digest, 1 + 16 * number, 16)
    return F.conv(part, 16, -10).cast("long")


def _bitsets(index: np.ndarray, posting: np.ndarray, postings: int) -> list[int]:
    out = [0] * postings
    for conversation, p in zip(index.tolist(), posting.tolist(), strict=True):
        out[p] |= 1 << conversation
    return out


def _members(bits: int, names: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((len(names) + 7) // 8, "little"), dtype=np.uint8)
    return names[np.unpackbits(raw, count=len(names), bitorder="little").astype(bool)]


_LOCAL = (
    "shard long, a long, b long, depth long, parent_a long, parent_b long, n long, conv_id long, "
    "words long, members array<long>, ends string"
)


def _shard_nodes(key: tuple, table: pa.Table) -> pa.Table:
    """Nodes of one shard and band. Position -1 is the root's, which every conversation has."""
    column = {c: table.column(c).to_numpy() for c in table.column_names}
    names, index = np.unique(column["conv_id"], return_inverse=True)
    base = int(column["pos"].min())
    level = column["pos"] - base
    turns = np.stack([level, column["a"], column["b"]])
    distinct, at, posting = np.unique(turns, axis=1, return_index=True, return_inverse=True)
    posting = posting.ravel()
    bits = _bitsets(index, posting, distinct.shape[1])
    depths = int(level.max()) + 1
    turn_at = np.full((depths, len(names)), -1, dtype=np.int64)
    turn_at[level, index] = posting
    present, ended = [0] * depths, [0] * depths
    for p, where in enumerate(distinct[0].tolist()):
        present[where] |= bits[p]
    for conversation, where in zip(
        index[column["last"]].tolist(), level[column["last"]].tolist(), strict=True
    ):
        ended[where] |= 1 << conversation
    lane_a, lane_b, words = distinct[1].tolist(), distinct[2].tolist(), column["words"][at].tolist()

    classes: dict[tuple[int, int], int] = {}
    start = level == 0
    for conversation, a, b in zip(
        index[start].tolist(), column["key_a"][start].tolist(), column["key_b"][start].tolist(), strict=True
    ):
        classes[a, b] = classes.get((a, b), 0) | 1 << conversation
    found: list[tuple] = []
    stack = [(0, group, a, b) for (a, b), group in classes.items()]
    while stack:
        where, group, a, b = stack.pop()
        rest = group & present[where]
        while rest:
            p = int(turn_at[where, (rest & -rest).bit_length() - 1])
            child = rest & bits[p]
            rest ^= child
            child_a, child_b = a ^ lane_a[p], b ^ lane_b[p]
            ends = child & ended[where]
            members = _members(child, names)
            found.append(
                (
                    key[0].as_py(),
                    child_a,
                    child_b,
                    where + base + 1,
                    a,
                    b,
                    child.bit_count(),
                    int(members[0]),
                    words[p],
                    members,
                    ",".join(map(str, _members(ends, names).tolist())) if ends else None,
                )
            )
            if where + 1 < depths:
                stack.append((where + 1, child, child_a, child_b))
    types = [pa.int64()] * 9 + [pa.list_(pa.int64()), pa.string()]
    columns = zip(*found, strict=True)
    fields = [f.split()[0] for f in _LOCAL.split(", ")]
    return pa.table(
        {f: pa.array(list(c), t) for f, c, t in zip(fields, columns, types, strict=True)}
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks joined by commas; a node's chunks come one after the other."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        values = [pa.array([x], pa.int64()) for x in node] + [pa.array([digest.hexdigest()])]
        return pa.RecordBatch.from_arrays(values, [*_NODE, "ends_sha256"])

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in _NODE]
        for *here, chunk in zip(*keys, batch.column("ends"), strict=True):
            if here != node:
                if node is not None:
                    yield row()
                node, digest = here, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(chunk.as_buffer())
    if node is not None:
        yield row()


def _upwards(paths: DataFrame) -> DataFrame:
    """Per node: ``saved`` and ``leaves`` of all path rows at or below it on the same conversation."""
    paths = paths.withColumn("band", F.floor(F.col("depth") / BAND))
    below = Window.partitionBy("conv_id", "band").orderBy(F.desc("depth"))
    within = paths.select(
        *_NODE,
        "conv_id",
        "band",
        *[F.sum(c).over(below).alias(c) for c in ("saved", "leaves")],
    )
    later = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    bands = paths.groupBy("conv_id", "band").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    bands = bands.select(
        "conv_id",
        "band",
        F.coalesce(F.sum("s").over(later), F.lit(0)).alias("s"),
        F.coalesce(F.sum("l").over(later), F.lit(0)).alias("l"),
    )
    return (
        within.join(bands, ["conv_id", "band"])
        .groupBy(*_NODE)
        .agg(
            F.sum(F.col("saved") + F.col("s")).alias("saved"),
            F.sum(F.col("leaves") + F.col("l")).alias("leaves"),
        )
    )


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, pos, digest, words) of ``convs``
    (conv_id, length)."""
    rows = written(
        turns.select("conv_id", "pos", "words", _lane(0).alias("a"), _lane(1).alias("b")), "turns"
    )
    alone = (
        rows.groupBy("pos", "a", "b")
        .agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
        .where(F.col("n") == 1)
        .groupBy("conv_id")
        .agg(F.min("pos").alias("cut"))
    )
    convs = written(
        convs.join(alone, "conv_id", "left").select(
            "conv_id", "length", F.coalesce("cut", "length").alias("cut")
        ),
        "cuts",
    )
    placed = rows.join(convs, "conv_id")
    shared = placed.where(F.col("pos") < F.col("cut")).withColumn("band", F.floor(F.col("pos") / BAND))
    bands = shared.groupBy("conv_id", "band").agg(F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(
        "conv_id",
        "band",
        F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("key_a"),
        F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("key_b"),
    )
    shard = F.expr(f"conv_id div {SHARD}").alias("shard")
    zero = F.lit(0).cast("long")
    roots = convs.select(
        shard,
        zero.alias("band"),
        "conv_id",
        F.lit(-1).cast("long").alias("pos"),
        *[zero.alias(c) for c in ("words", "a", "b")],
        (F.col("length") == 0).alias("last"),
        *[zero.alias(c) for c in ("key_a", "key_b")],
    )
    last = (F.col("pos") + 1 == F.col("length")).alias("last")
    indexed = shared.join(bands, ["conv_id", "band"]).select(
        shard, "band", "conv_id", "pos", "words", "a", "b", last, "key_a", "key_b"
    )
    local = written(
        indexed.unionByName(roots).groupBy("shard", "band").applyInArrow(_shard_nodes, _LOCAL),
        "shard-nodes",
    )
    merged = local.groupBy(*_NODE).agg(
        F.sum("n").alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.min("words").alias("words"),
        F.min("parent_a").alias("parent_a"),
        F.min("parent_b").alias("parent_b"),
    )
    paths = local.select(*_NODE, F.explode("members").alias("conv_id"))
    tails = convs.where(F.col("cut") < F.col("length"))
    hung = tails.select("conv_id", F.col("cut").alias("depth")).join(paths, ["conv_id", "depth"])
    hung = written(hung.select("conv_id", *_NODE), "hung")  # the shared node that each tail begins at
    parent = [F.col("parent_a").alias("a"), F.col("parent_b").alias("b"), (F.col("depth") - 1).alias("depth")]
    children = (
        merged.where(F.col("depth") > 0)
        .select(*parent)
        .unionAll(hung.select(*_NODE))
        .groupBy(*_NODE)
        .agg(F.count("*").alias("n_children"))
    )
    nodes = written(
        merged.join(children, [*_NODE], "left").fillna(0, ["n_children"]), "nodes"
    )
    marks = (
        nodes.select(
            "conv_id",
            "depth",
            ((F.col("n") - 1) * F.col("words")).alias("saved"),
            (F.col("n_children") == 0).cast("long").alias("leaves"),
        )
        .unionAll(hung.select("conv_id", "depth", zero, F.lit(1).cast("long")))
        .groupBy("conv_id", "depth")
        .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    )
    marked = paths.join(marks, ["conv_id", "depth"], "left").fillna(0, ["saved", "leaves"])
    ends = (
        local.where(F.col("ends").isNotNull())
        .select(*_NODE, "shard", "ends")
        .repartition(*_NODE)
        .sortWithinPartitions(*_NODE, "shard")
        .mapInArrow(_hashed, "a long, b long, depth long, ends_sha256 string")
    )
    above = nodes.select(
        F.col("a").alias("parent_a"),
        F.col("b").alias("parent_b"),
        (F.col("depth") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    common = (
        nodes.join(_upwards(marked), [*_NODE])
        .join(ends, [*_NODE], "left")
        .join(above, ["parent_a", "parent_b", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
        )
    )
    starts = hung.join(nodes.select(*_NODE, F.col("conv_id").alias("start")), [*_NODE])
    starts = starts.select("conv_id", "start")
    done = F.col("pos") + 1 == F.col("length")
    single = (
        placed.where(F.col("pos") >= F.col("cut"))
        .join(starts, "conv_id")
        .select(
            "conv_id",
            (F.col("pos") + 1).alias("depth"),
            F.when(F.col("pos") == F.col("cut"), F.col("start")).otherwise(F.col("conv_id")),
            F.lit(1).cast("long"),
            F.when(done, 0).otherwise(1).cast("long"),
            F.lit(1).cast("long"),
            zero,
            F.when(done, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_EMPTY)),
        )
    )
    return common.unionAll(single)


def prefix_trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The trie of all conversations after their heads are shared in families."""
    turns = turns_of(conversations)
    return trie(*rebuilt(written(turns, "positions"), family, heads))
