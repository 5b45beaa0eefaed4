"""Prefix trie of conversations: families first, then their combined nodes.

A family is the conversations of one base id (a multiple of 20) and the 19 ids after it; each opens with up to three turns of
the base conversation. Families are cogrouped with their base's first turns, rebuilt, and made into small tries; a family's
node carries its members, twenty at most. Only these combined nodes are shuffled to be merged by the digest of their path.

What a node's subtree saves and how many leaves it has are sums over the conversations that pass through it: a conversation
saves the words of its turns that a smaller member already has, and owns the leaf where it ends, if it is the least there. So
no node walks its subtree, and the work is linear in the turns. Nodes of one conversation need no sum at all.

No group is unbounded: a conversation is cut into chunks of CHUNK turns of its rebuilt form, numbered by ranges of a global
order and not in a window; the digests of its chunks are chained first, so that each chunk's trie knows where it starts. The
ids that end in a node are joined in blocks and hashed as a sorted stream.

Defined cases: null role and text are empty; null turns come first; turns that tie are ordered by the digest of role and text;
repeated rows are turns of their own; rows without conv_id belong to no conversation and are left out; a negative id's base is
the multiple of 20 below it; long texts are read whole; an empty table has no nodes; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import n_words, text_of, written
from marketlens.llm.sharding import row_numbers

#: Fixed by the contract: conversations of a family, and the most turns that one takes from its base plus one.
FAMILY, HEADS = 20, 4
#: Turns of a conversation in one group; ids of conversations in one block of ends.
CHUNK, BLOCK = 1024, 20 * 1024

NODES = "family long, chunk long, node binary, parent binary, depth long, words long, before long, convs array<long>, ends array<long>"
LINKS = "conv_id long, chunk long, link binary, words long"
STARTS = "family long, chunk long, conv_id long, pos long, digest binary, words long"


def chained(before: bytes, one: bytes) -> bytes:
    return hashlib.sha256(before + one).digest()[:16]


def heads_of(conv_id: int) -> int:
    """Turns that a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def placed(conversations: DataFrame, chunk: int) -> DataFrame:
    """family, chunk, conv_id, pos, depth, length, digest, words: a turn's place in its own and in the rebuilt conversation.

    Turns that the base's replace have no depth; of these only the first stays, to tell that the conversation is there.
    """
    role, text = text_of("role"), text_of("text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    narrow = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), n_words().alias("words"))
    rows = row_numbers(narrow, "conv_id", "turn", "digest", name="row")
    counts = rows.groupBy("conv_id").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    base = counts.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("family"), F.col("n").alias("base_n"))
    own = rows.join(counts, "conv_id").withColumn("family", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(base, "family", "left")
    pos, h = F.col("row") - F.col("first"), F.crc32(F.col("conv_id").cast("string")) % HEADS
    taken = F.least(h, F.coalesce("base_n", F.lit(0)))
    out = own.select("family", "conv_id", pos.alias("pos"), F.when(pos >= h, taken + pos - h + 1).alias("depth"), (taken + F.greatest(F.col("n") - h, F.lit(0))).alias("length"), "digest", "words")
    out = out.where("depth IS NOT NULL OR pos = 0 OR (conv_id = family AND pos < 3)")
    return out.select("family", F.coalesce(F.floor((F.col("depth") - 1) / chunk), F.lit(0)).cast("long").alias("chunk"), *out.columns[1:])


def _sequences(left: pa.Table, right: pa.Table) -> tuple[dict, dict, dict]:
    """Of one group: the rebuilt turns (depth, digest, words) of each conversation, its length, and where its chunk starts."""
    turns: dict[int, list] = {}
    length: dict[int, int] = {}
    for conv, depth, n, digest, words in zip(*(left.column(c).to_pylist() for c in ("conv_id", "depth", "length", "digest", "words"))):
        own = turns.setdefault(conv, [])
        length[conv] = n
        if depth is not None:
            own.append((depth, digest, words))
    heads, starts = [], {}
    for conv, pos, digest, words in zip(*(right.column(c).to_pylist() for c in ("conv_id", "pos", "digest", "words"))):
        if conv is None:
            heads.append((pos + 1, digest, words))
        else:
            starts[conv] = (digest, words)
    heads.sort()
    for conv, own in turns.items():
        if conv not in starts:
            own += heads[: heads_of(conv)]
        own.sort()
    return turns, length, starts


def _links(left: pa.Table, right: pa.Table) -> pa.Table:
    """The digest and the words of each conversation's part in this group."""
    turns, _, _ = _sequences(left, right)
    chunk, out = left.column("chunk")[0].as_py() if left.num_rows else 0, []
    for conv, own in turns.items():
        local = b""
        for _, digest, _ in own:
            local = chained(local, digest)
        out.append((conv, chunk, local, sum(w for *_, w in own)))
    columns = list(zip(*out)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["conv_id", "chunk", "link", "words"])


def _trie(left: pa.Table, right: pa.Table) -> pa.Table:
    """One group's trie, a row for each node."""
    turns, length, starts = _sequences(left, right)
    family, chunk = (left.column(c)[0].as_py() if left.num_rows else 0 for c in ("family", "chunk"))
    nodes: dict[bytes, tuple] = {}

    def visit(node: bytes, parent: bytes | None, depth: int, words: int, before: int, conv: int) -> None:
        convs, ends = nodes.setdefault(node, (parent, depth, words, before, [], []))[4:]
        convs.append(conv)
        if depth == length[conv]:
            ends.append(conv)

    for conv in sorted(turns):
        at, before = starts.get(conv, (b"", 0))
        start, local = at, b""
        if chunk == 0:
            visit(b"", None, 0, 0, 0, conv)
        for depth, digest, words in turns[conv]:
            local = chained(local, digest)
            node = chained(start, local) if chunk else local
            visit(node, at, depth, words, before, conv)
            at, before = node, before + words
    rows = [(family, chunk, k, *v) for k, v in nodes.items()]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["family", "chunk", "node", "parent", "depth", "words", "before", "convs", "ends"]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 9, types)], names=names)


def _starts(links: pa.Table) -> pa.Table:
    """Where each chunk of one conversation starts: the node at the end of the chunk before, and the words until there."""
    rows = sorted(zip(*(links.column(c).to_pylist() for c in ("chunk", "link", "words", "conv_id"))))
    out, at, before = [], b"", 0
    for chunk, link, words, conv in rows:
        at, before = chained(at, link) if chunk else link, before + words
        out.append((conv - conv % FAMILY, chunk + 1, conv, 0, at, before))
    types = (pa.int64(),) * 4 + (pa.binary(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=["family", "chunk", "conv_id", "pos", "digest", "words"])


def family_nodes(turns: DataFrame, chunk: int) -> DataFrame:
    """The nodes of all families' tries. turns: a written table of `placed`."""
    own = turns.where("depth IS NOT NULL OR pos = 0")
    heads = turns.where("conv_id = family AND pos < 3").select("family", F.lit(0).cast("long").alias("chunk"), F.lit(None).cast("long").alias("conv_id"), "pos", "digest", "words")
    long = own.where(F.col("length") > chunk)
    if not long.isEmpty():
        some = heads.join(long.select(F.col("family").alias("of")).distinct(), F.col("family") == F.col("of"), "left_semi").toDF(*heads.columns)
        parts = long.groupBy("family", "chunk").cogroup(some.groupBy("family", "chunk")).applyInArrow(_links, LINKS)
        heads = heads.unionByName(written(parts.groupBy("conv_id").applyInArrow(_starts, STARTS), "starts"))
    return own.groupBy("family", "chunk").cogroup(heads.groupBy("family", "chunk")).applyInArrow(_trie, NODES)


def merged(nodes: DataFrame) -> DataFrame:
    """node, parent, depth, words, before, n, owner, n_children, parent_owner: families' nodes of one path made one."""
    one = nodes.groupBy("node", "parent", "depth", "words", "before").agg(F.sum(F.size("convs")).cast("long").alias("n"), F.min(F.col("convs")[0]).alias("owner"))
    one = written(one, "trie")
    children = one.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = one.select(F.col("node").alias("parent"), F.col("owner").alias("parent_owner"))
    return one.join(children, "node", "left").join(above, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def subtrees(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """node, saved_tokens, n_leaves of the nodes that several conversations share."""
    shared = full.where("n > 1").select("node", "owner", "n_children")
    each = nodes.join(shared, "node").select("node", "before", (F.col("before") + F.col("words")).alias("upto"), "owner", "n_children", "ends", F.explode("convs").alias("conv"))
    loses = F.array_contains("ends", F.col("conv")) & ((F.col("owner") != F.col("conv")) | (F.col("n_children") > 0))
    each = each.select("node", "before", "conv", F.when(F.col("owner") != F.col("conv"), F.col("upto")).alias("upto"), loses.cast("long").alias("lost"))
    of = each.groupBy("conv").agg(F.coalesce(F.max("upto"), F.lit(0)).alias("saved_upto"), F.max("lost").alias("lost_leaf"))
    shares = each.join(of, "conv").groupBy("node")
    return shares.agg(F.sum(F.greatest(F.col("saved_upto") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum(1 - F.col("lost_leaf")).alias("n_leaves"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, block, ids), a node's together and in order -> node, ends_sha256."""
    at, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != at:
                done += [(at, digest.hexdigest())] if digest else []
                at, digest = node, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.record_batch([pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], names=["node", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends(nodes: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes in which conversations end. Blocks of ids are joined first, then each node's blocks pass in order."""
    some = nodes.where(F.size("ends") > 0).select("node", F.floor(F.col("family") / BLOCK).alias("block"), F.struct("family", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids")).alias("part"))
    blocks = some.groupBy("node", "block").agg(F.array_join(F.sort_array(F.collect_list("part"))["ids"], ",").alias("ids"))
    return blocks.repartition("node").sortWithinPartitions("node", "block").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, a row for each node."""
    turns = written(placed(conversations, chunk), "turns")
    nodes = written(family_nodes(turns, chunk), "family-nodes")
    full = written(merged(nodes), "nodes")
    out = full.join(subtrees(nodes, full), "node", "left").join(ends(nodes), "node", "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
