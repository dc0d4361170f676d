"""Tries of conversation prefixes, packed as double arrays, one for each bucket of prefix shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import let
from taskmill.scale import discard, lookup, partitions, settle, stage

# Turns that one bucket of shards holds on average, at most.
BUCKET_TURNS = 100_000
# Conversations share the first turns of the one that begins their block.
BLOCK, SHARED = 100, 6
# Ids are joined to text in runs of 2^12 before they are hashed in order.
RUN_BITS = 12
# Places that are tried for a node with several children before the arrays are made longer.
TRIES = 64
KEY_BYTES = 16
ROOT_KEY = bytes(KEY_BYTES)
NOTHING = hashlib.sha256(b"").hexdigest()

_SEQUENCES = pa.schema([
    ("path", pa.list_(pa.binary())), ("keys", pa.list_(pa.binary())), ("chars", pa.list_(pa.int32())),
    ("n", pa.int64()), ("first_id", pa.int64()), ("ends", pa.string()),
])
SEQUENCES = "path array<binary>, keys array<binary>, chars array<int>, n long, first_id long, ends string"
_NODES = pa.schema([
    ("upper", pa.bool_()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends_sha256", pa.string()),
])
NODES = (
    "upper boolean, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string"
)
RESULT = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
)


class DoubleArray:
    """A trie over dense turn ids: the child of ``state`` by id ``code`` is ``base[state] + code``,
    if ``check`` says there that its parent is ``state``."""

    def __init__(self) -> None:
        self.base = [0, 0]
        self.check = [-1, -1]
        self.free = 2

    def _reach(self, size: int) -> None:
        grow = size - len(self.check)
        if grow > 0:
            self.base.extend([0] * grow)
            self.check.extend([0] * grow)

    def place(self, state: int, codes: list[int]) -> list[int]:
        """Give a node its children: the first base at which all their places are free."""
        check, low, high = self.check, min(codes), max(codes)
        at = self.free
        self._reach(at + 1)
        while check[at]:
            at += 1
            self._reach(at + 1)
        self.free = at
        for _ in range(TRIES if len(codes) > 1 else 1):
            self._reach(at - low + high + 1)
            if all(not check[at - low + c] for c in codes):
                break
            at += 1
            while at < len(check) and check[at]:
                at += 1
        else:
            at = len(check)
            self._reach(at - low + high + 1)
        self.base[state] = at - low
        places = [at - low + c for c in codes]
        for place in places:
            check[place] = state
        return places

    def child(self, state: int, code: int) -> int:
        place = self.base[state] + code
        return place if 0 < place < len(self.check) and self.check[place] == state else 0


def pack(paths: list[list[bytes]]) -> tuple[DoubleArray, dict[bytes, int], list[tuple[int, int]]]:
    """Pack sorted, distinct paths level by level; also the dense ids and the (state, depth) of all nodes.

    Ids are given in the order of the levels, so that siblings mostly have neighbouring ones.
    """
    trie, codes = DoubleArray(), {}
    nodes = [(1, 0)]
    ranges = [(0, len(paths))]
    for (state, depth), (low, high) in zip(nodes, ranges):
        if low < high and len(paths[low]) == depth:
            low += 1
        turns, begin = [], []
        for i in range(low, high):
            turn = paths[i][depth]
            if not turns or turn != turns[-1]:
                turns.append(turn)
                begin.append(i)
        if turns:
            for place, a, b in zip(
                trie.place(state, [codes.setdefault(t, len(codes) + 1) for t in turns]), begin, [*begin[1:], high]
            ):
                nodes.append((place, depth + 1))
                ranges.append((a, b))
    return trie, codes, nodes


def _nodes(table: pa.Table) -> pa.Table:
    """All nodes of a bucket; those above the cuts of their paths as parts that other buckets may add to."""
    rows = sorted(table.to_pylist(), key=lambda r: r["path"])
    trie, codes, nodes = pack([r["path"] for r in rows])
    size = len(trie.check)
    convs, children, leaves, saved, chars = ([0] * size for _ in range(5))
    first, ends, key, parent_key, cut = ([None] * size for _ in range(5))
    for r in rows:
        state, n, id_ = 1, r["n"], r["first_id"]
        turns = zip(r["path"], r["keys"], r["chars"])
        last = ROOT_KEY
        while True:
            convs[state] += n
            if first[state] is None or id_ < first[state]:
                first[state] = id_
            cut[state] = r["cut"]
            step = next(turns, None)
            if step is None:
                ends[state] = r["ends"]
                break
            state = trie.child(state, codes[step[0]])
            chars[state], key[state], parent_key[state], last = step[2], step[1], last, step[1]
    key[1] = ROOT_KEY
    out = {f.name: [] for f in _NODES}
    for state, depth in reversed(nodes):
        upper, parent = depth < cut[state], trie.check[state]
        if not upper:
            leaves[state] += children[state] == 0
            saved[state] += (convs[state] - 1) * chars[state]
        if parent > 0:
            leaves[parent] += leaves[state]
            saved[parent] += saved[state]
            children[parent] += not upper
        top = depth == cut[state]
        out["upper"].append(upper)
        out["key"].append(key[state] if upper else None)
        out["parent_key"].append(parent_key[state] if upper or top else None)
        out["depth"].append(depth)
        out["conv_id"].append(first[state])
        out["parent_conv_id"].append(None if upper or top else first[parent])
        out["n_convs"].append(convs[state])
        out["n_children"].append(children[state])
        out["n_leaves"].append(leaves[state])
        out["saved_tokens"].append(saved[state])
        out["chars"].append(chars[state])
        out["ends_sha256"].append(ends[state] if upper else ends[state] or NOTHING)
    return pa.Table.from_pydict(out, schema=_NODES)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal paths, in the order of their ids, become one row: the ids pass through the hash in a stream."""
    path, chars, n, first, digest = None, None, 0, None, None

    def row() -> dict:
        keys, last = [], ROOT_KEY
        for turn in path:
            last = hashlib.sha256(last + turn).digest()[:KEY_BYTES]
            keys.append(last)
        return {"path": path, "keys": keys, "chars": chars, "n": n, "first_id": first, "ends": digest.hexdigest()}

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["path"] != path:
                if path is not None:
                    done.append(row())
                path, chars, n, first, digest = r["path"], r["chars"], 0, r["first_id"], hashlib.sha256()
            digest.update((("," if n else "") + r["ids"]).encode())
            n += r["n"]
        yield pa.RecordBatch.from_pylist(done, _SEQUENCES)
    if path is not None:
        yield pa.RecordBatch.from_pylist([row()], _SEQUENCES)


def rebuilt(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: int = BLOCK, shared: int = SHARED,
) -> DataFrame:
    """(conv_id, turns): every conversation behind the first turns of the one that begins its block.

    The first crc32(id) % ``shared`` turns come from conversation id - id % ``block``, as far as it has
    them; the conversation's own follow from there on. A turn is the first 128 bits of the SHA-256 of its
    role and text, with the code points of the text. Turns are ordered by ``turn``, null first, ties by
    digest.
    """
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    speaker = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    whole = F.sha2(F.concat(F.char_length(speaker).cast("string"), F.lit(":"), speaker, said), 256)
    # Digests sort before the sizes, which depend on them.
    one = F.struct(
        F.col(f"`{turn}`").cast("long").alias("turn"), F.unhex(F.substring(whole, 1, 2 * KEY_BYTES)).alias("digest"),
        F.char_length(said).alias("chars"),
    )
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), one.alias("one"))
    turns = F.transform(F.array_sort(F.collect_list("one")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    own = stage(rows.groupBy("conv_id").agg(turns.alias("own")), "conversations")
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, shared).alias("head"))
    of_block = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(first, "base", "left")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(shared)).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("taken")), F.array().cast("array<struct<digest:binary,chars:int>>"))
    rest = F.slice("own", F.col("taken") + 1, F.greatest(F.size("own") - F.col("taken"), F.lit(0)))
    return of_block.withColumn("taken", taken).select("conv_id", F.concat(head, rest).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """The distinct sequences of turns, with the number, the least and the hash of the ids that have them."""
    ids = let(F.array_sort(F.collect_list("conv_id")), lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ","))
    runs = conversations.select(
        "conv_id", F.col("turns.digest").alias("path"), F.col("turns.chars").alias("chars"),
        F.shiftright("conv_id", RUN_BITS).alias("run"),
    ).groupBy("path", "chars", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_id"), ids.alias("ids")
    )
    return runs.repartition("path").sortWithinPartitions("path", "run").mapInArrow(_sequences, SEQUENCES)


def _cut(found: DataFrame, buckets: int, turns: int) -> DataFrame:
    """For each sequence the depth from which its prefix is a shard of its own, and the shard's bucket.

    A prefix is hot if its sequences have more turns than an average bucket. A shard begins at the first
    prefix that is not; it is whole in one bucket. What lies above is in several.
    """
    per_prefix = found.select(F.size("path").alias("turns"), F.explode("keys").alias("key"))
    hot = per_prefix.groupBy("key").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"))
    hot = settle(hot.where((F.col("turns") > turns / buckets) & (F.col("n") > 1)).select("key"))
    last = F.coalesce(F.get(F.col("keys"), F.size("keys") - 1), F.lit(ROOT_KEY))
    along = found.select(last.alias("last"), F.posexplode("keys").alias("place", "key"))
    deepest = lookup(along, hot, ["key"], "left_semi").groupBy("last").agg((F.max("place") + 2).alias("cut"))
    cut = found.withColumn("last", last).join(deepest, "last", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    shard = F.coalesce(F.get(F.col("keys"), F.col("cut") - 1), F.col("last"))
    return cut.select(*found.columns, "cut", F.pmod(F.xxhash64(shard), F.lit(buckets)).cast("int").alias("bucket"))


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes above the cuts, whose parts lie in several buckets, with sums over their subtrees.

    Sums of the shards below are added at once. What the upper nodes add themselves is known only now: it
    moves up by twice as many levels each round, so the rounds grow with the logarithm of the depth.
    """
    nodes = stage(parts.where("upper").groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("tops"), F.sum("n_leaves").alias("shard_leaves"),
        F.sum("saved_tokens").alias("shard_saved"), F.min("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256"),
    ), "upper")
    below = settle(nodes.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("uppers")))
    nodes = lookup(nodes, below, ["key"]).withColumn("n_children", F.col("tops") + F.coalesce("uppers", F.lit(0)))
    nodes = stage(nodes, "upper")
    sums = nodes.select(
        "key", F.col("parent_key").alias("up"), (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    for _ in range(math.ceil(math.log2((nodes.agg(F.max("depth")).first()[0] or 0) + 1))):
        sums = settle(sums)
        added = sums.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        jump = sums.select(F.col("key").alias("up"), F.col("up").alias("next"))
        sums = lookup(lookup(sums, settle(added), ["key"]), jump, ["up"]).select(
            "key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
    return nodes.join(sums.drop("up"), "key").select(
        "key", "parent_key", "depth", "conv_id", "n_convs", "n_children",
        (F.col("shard_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("shard_saved") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def prefix_nodes(conversations: DataFrame, bucket_turns: int = BUCKET_TURNS, **columns: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations (``rebuilt``), one row for each distinct prefix.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent (null at the root),
    ``n_convs`` the members, ``n_children`` and ``n_leaves`` (childless nodes of the subtree) count nodes,
    ``saved_tokens`` sums (members - 1) times the code points of a node's last text over the subtree, and
    ``ends_sha256`` hashes the comma-joined ids of the conversations that end at the node.

    Equal conversations become one sequence with a count first. Sequences are sharded by the shortest
    prefix that is not hot; a bucket of shards is packed into a double array over its own dense turn ids,
    and traversed for its nodes. Nodes above the shards, the root and hot prefixes, have parts in
    several buckets; these are merged globally.

    Rows without conv_id belong to no conversation. Null roles and texts are empty, null turns come first,
    rows that repeat a turn each count. Texts of any length are one digest. A conversation is one row of
    about 40 bytes a turn and passes through one task; the ids that end at one node pass through one
    task in a stream, since a hash has to see them in order. An empty table has no node, not even a root.
    """
    found = stage(sequences(rebuilt(conversations, **columns)), "sequences")
    turns = found.agg(F.sum(F.size("path"))).first()[0] or 0
    buckets = max(partitions(conversations.sparkSession), math.ceil(turns / bucket_turns))
    parts = stage(_cut(found, buckets, turns).groupBy("bucket").applyInArrow(_nodes, NODES), "nodes")
    discard(found)
    upper = stage(_merged(parts), "upper")
    known = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    inside = parts.where(~F.col("upper") & F.col("parent_key").isNull()).select(*RESULT)
    joints = parts.where(~F.col("upper") & F.col("parent_key").isNotNull()).drop("parent_conv_id")
    above = lambda rows: lookup(rows, known, ["parent_key"]).withColumnRenamed("above", "parent_conv_id").select(*RESULT)
    return inside.unionByName(above(joints)).unionByName(above(upper))
