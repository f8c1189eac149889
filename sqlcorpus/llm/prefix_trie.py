"""Prefix trie of conversations, built as adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is the first ``ID_BYTES`` bytes of the SHA-256 of its role and text, and a conversation's key
is the ids of its turns in a row, so that the bytes' order keeps every subtree together and all ids have
the same width. Texts are read once and never shuffled.

1. Equal keys are one sequence. The ids of its conversations are joined in blocks of at most 65,536 values
   and hashed block by block, so that a third of all conversations may be copies of one.
2. Sequences are range-partitioned by key. Each run of at most ``TREE_TURNS`` turns goes into one adaptive
   radix tree (inner nodes of 4, 16, 48 or 256 children, compressed paths). Only byte depths that are a
   whole number of ids give nodes.
3. A node off the paths to a tree's first and last key is complete: nothing of it lies in another tree.
   Only the nodes on these two paths are shuffled and merged by the digest of their prefix.
4. Sums over subtrees are complete below the merged nodes; the merged nodes add them up by doubling the
   distance to their ancestors in each round.

Defined cases: turns are ordered by ``turn`` (null first), then role, then text; null role and text are
empty; rows that repeat a turn are turns of their own; rows with a null conversation id belong to no
conversation and are left out; a conversation without turns counts at the root; an empty table has no
root; further columns are ignored. A conversation's turn ids and their sort keys (not its texts, unless
several turns share a number) meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import attach
from sqlcorpus.session import stage

ID_BYTES = 16
#: Turns of one tree; conversation ids that are joined into one text, as a power of two.
TREE_TURNS = 100_000
BLOCK_BITS = 16
_SEQUENCE = "key binary, words array<int>, n bigint, conv_id bigint, ends string"
_NODE = (
    "kind int, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, words bigint, ends_sha256 string"
)
#: Kinds of rows: complete; complete but for the parent, which is merged; a part of a merged node.
COMPLETE, UNDER_MERGED, PARTIAL = range(3)
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and its ``turns`` in order, each with ``id`` and ``words``; every id that occurs has a row.

    Texts take part in the order only where a conversation repeats a turn number.
    """
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    whole = F.concat_ws("", F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    ident = F.unhex(F.substring(F.sha2(F.encode(whole, "UTF-8"), 256), 1, 2 * ID_BYTES))
    turn = F.struct("turn", ident.alias("id"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"))
    gathered = stage(
        rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "conversation-turns")
    tied = F.exists(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: F.get("turns", i)["turn"].eqNullSafe(F.get("turns", i - 1)["turn"]) & (F.get("turns", i)["id"] != F.get("turns", i - 1)["id"]))
    marked = gathered.withColumn("_tied", F.when(F.size("turns") > 1, tied).otherwise(F.lit(False)))
    by_text = (
        rows.join(marked.where("_tied").select("conv_id"), "conv_id", "left_semi").select("conv_id", F.struct("turn", "role", "text", turn.alias("t")).alias("s"))
        .groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]).alias("turns")))
    return marked.where("NOT _tied").select("conv_id", "turns").unionByName(by_text)


def sequences(conversations: DataFrame) -> DataFrame:
    """Conversations ``(conv_id, turns)`` to distinct sequences ``_SEQUENCE`` with their number of
    conversations, the smallest id, and the SHA-256 of all ids in order, comma-joined."""
    key = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")
    rows = conversations.select("conv_id", F.unhex(key).alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = rows.withColumn("seq", F.unhex(F.substring(F.sha2("key", 256), 1, 32)))
    blocks = rows.groupBy("seq", F.call_function("shiftright", F.col("conv_id"), F.lit(BLOCK_BITS)).alias("block")).agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return blocks.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(_hash_blocks, _SEQUENCE)


def _hash_blocks(batches) -> Iterator:
    """Rows of a sequence follow one another in order of their blocks; one row comes out for each sequence."""
    import hashlib

    import pyarrow as pa

    kind = pa.schema([("key", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    current, done, state = None, [], None

    def finish():
        if current is not None:
            done.append({**current, "ends": state.hexdigest()})

    for batch in batches:
        for seq, key, words, n, first, ids in zip(*[batch.column(c).to_pylist() for c in ("seq", "key", "words", "n", "conv_id", "ids")], strict=True):
            if current is not None and current["seq"] == seq:
                current["n"] += n
                state.update(b"," + ids.encode())
            else:
                finish()
                current, state = {"seq": seq, "key": key, "words": words, "n": n, "conv_id": first}, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kind)
            done = []
    finish()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=kind)


class RadixNode:
    """A node of an adaptive radix tree: a compressed path, a value, and 4, 16, 48 or 256 places for children.

    With 4 and 16 places ``keys`` lists the children's bytes, with 48 it maps every byte to a place.
    """

    __slots__ = ("path", "value", "room", "count", "keys", "kids")

    def __init__(self, path: bytes, value=None):
        self.path, self.value, self.room, self.count, self.keys, self.kids = path, value, 4, 0, bytearray(), []

    def child(self, byte: int):
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            return self.kids[self.keys[byte] - 1] if self.keys[byte] else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def children(self):
        """``(byte, child)`` in the bytes' order."""
        if self.room == 256:
            return [(b, kid) for b, kid in enumerate(self.kids) if kid is not None]
        if self.room == 48:
            return [(b, self.kids[at - 1]) for b, at in enumerate(self.keys) if at]
        return sorted(zip(self.keys, self.kids, strict=True), key=lambda x: x[0])

    def add(self, byte: int, kid) -> None:
        if self.count == self.room:
            self._grow()
        if self.room == 256:
            self.kids[byte] = kid
        else:
            self.kids.append(kid)
            if self.room == 48:
                self.keys[byte] = len(self.kids)
            else:
                self.keys.append(byte)
        self.count += 1

    def _grow(self) -> None:
        old, self.room = self.children(), {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.keys, self.kids = bytearray(256), [kid for _, kid in old]
            for at, (byte, _) in enumerate(old):
                self.keys[byte] = at + 1
        elif self.room == 256:
            self.keys, self.kids = bytearray(), [None] * 256
            for byte, kid in old:
                self.kids[byte] = kid

    def split(self, at: int) -> None:
        """End the path after ``at`` bytes; what followed becomes the only child."""
        lower = RadixNode(self.path[at + 1 :], self.value)
        lower.room, lower.count, lower.keys, lower.kids = self.room, self.count, self.keys, self.kids
        byte, self.path, self.value = self.path[at], self.path[:at], None
        self.room, self.count, self.keys, self.kids = 4, 0, bytearray(), []
        self.add(byte, lower)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    if a[: len(b)] == b[: len(a)]:
        return min(len(a), len(b))
    low, high = 0, min(len(a), len(b))
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def insert(root: RadixNode, key: bytes, value) -> None:
    node, at = root, 0
    while True:
        rest = key[at : at + len(node.path)]
        same = common(node.path, rest)
        if same < len(node.path):
            node.split(same)
        at += same
        if at == len(key):
            node.value = value
            return
        kid = node.child(key[at])
        if kid is None:
            node.add(key[at], RadixNode(key[at + 1 :], value))
            return
        node, at = kid, at + 1


def _prefix_digests(key: bytes, width: int) -> list[bytes]:
    """Digests of the key's prefixes of 0, 1, 2 ... ids."""
    import hashlib

    state, out = hashlib.sha256(), []
    for at in range(0, len(key) + 1, width):
        out.append(state.copy().digest()[:16])
        state.update(key[at : at + width])
    return out


def nodes_of(root: RadixNode, first: bytes, last: bytes, width: int = ID_BYTES) -> list[dict]:
    """Rows ``_NODE`` of a tree whose smallest and greatest keys are ``first`` and ``last``.

    Values are ``(key, words, n, conv_id, ends)``. Every inner node is visited after its children and turns
    into one row for each whole id that its edge and path complete.
    """
    edges = [(key, _prefix_digests(key, width)) for key in (first, last)]
    out: list[dict] = []
    # of each visited node: members, smallest id, a key below it with its words, open rows, leaves, saved tokens
    done: dict[int, tuple] = {}
    todo = [(root, 0, 0, False)]  # node, byte depth above its edge, byte depth of its end, children visited
    while todo:
        node, above, end, visited = todo.pop()
        if not visited:
            todo.append((node, above, end, True))
            todo += [(kid, end, end + 1 + len(kid.path), False) for _, kid in node.children()]
            continue
        members, least, sample, tops, leaves, saved = 0, None, None, [], 0, 0
        below = [done.pop(id(kid)) for _, kid in node.children()]
        if node.value is not None:
            key, words, n, conv_id, _ = node.value
            members, least, sample = n, conv_id, (key, words)
        for n, low, keyed, rows, l, s in below:
            members, leaves, saved, sample = members + n, leaves + l, saved + s, sample or keyed
            least = low if least is None else min(least, low)
            tops += rows
        key, words = sample
        depths = list(range(end // width, above // width, -1)) + ([0] if node is root else [])
        shared = [common(key, edge) // width for edge, _ in edges] if depths else []
        for depth in depths:
            merged = next((digests for (_, digests), n in zip(edges, shared, strict=True) if depth <= n), None)
            own = words[depth - 1] if depth else 0
            row = {
                "kind": COMPLETE, "node": None, "parent": None, "conv_id": least, "depth": depth, "parent_conv_id": None, "n_convs": members,
                "n_children": len(tops), "words": own,
                "ends_sha256": node.value[4] if node.value is not None and depth * width == end else None,
            }
            if merged is None:
                for top in tops:
                    top["parent_conv_id"] = least
                leaves, saved = leaves if tops else 1, saved + (members - 1) * own
                row["n_leaves"], row["saved_tokens"] = leaves, saved
                tops = [row]
            else:
                for top in tops:
                    top["kind"], top["parent"] = UNDER_MERGED, merged[depth]
                row["kind"], row["node"], row["n_leaves"], row["saved_tokens"] = PARTIAL, merged[depth], leaves, saved
                row["parent"] = merged[depth - 1] if depth else None
                tops, leaves, saved = [], 0, 0
            out.append(row)
        done[id(node)] = (members, least, sample, tops, leaves, saved)
    return out


def _trees(batches) -> Iterator:
    """Sorted distinct sequences to the rows of consecutive trees."""
    import pyarrow as pa

    kind = pa.schema([
        ("kind", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()),
        ("ends_sha256", pa.string()),
    ])
    root, turns, first, last = RadixNode(b""), 0, None, None
    for batch in batches:
        for value in zip(*[batch.column(c).to_pylist() for c in ("key", "words", "n", "conv_id", "ends")], strict=True):
            if first is not None and turns + len(value[1]) > TREE_TURNS:
                yield pa.RecordBatch.from_pylist(nodes_of(root, first, last), schema=kind)
                root, turns, first = RadixNode(b""), 0, None
            insert(root, value[0], value)
            first, last, turns = value[0] if first is None else first, value[0], turns + len(value[1])
    if first is not None:
        yield pa.RecordBatch.from_pylist(nodes_of(root, first, last), schema=kind)


def merge_nodes(parts: DataFrame) -> DataFrame:
    """The merged nodes, each with ``node, parent`` and the columns of the result but ``parent_conv_id``.

    ``parts`` are the PARTIAL rows. Round k adds to every node the sums of the nodes 2^k below it, which
    hold all nodes less than 2^k below themselves.
    """
    nodes = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.first("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"))
    inner = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_inner"))
    children = F.col("n_children") + F.coalesce("_inner", F.lit(0))
    nodes = nodes.join(inner, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", children.alias("n_children"),
        (F.col("n_leaves") + (children == 0).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        "ends_sha256")
    nodes = stage(nodes, "trie-merged")
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"]
    sums, up = nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), 1
    while deepest is not None and up <= deepest:
        gain = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        further = sums.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        zero = F.lit(0).cast("long")
        sums = stage(
            sums.join(gain, "node", "left").join(further, "up", "left").select(
                "node", F.col("_up").alias("up"), (F.col("n_leaves") + F.coalesce("_l", zero)).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("_s", zero)).alias("saved_tokens")), "trie-sums")
        up *= 2
    return nodes.drop("n_leaves", "saved_tokens").join(sums.drop("up"), "node")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations ``(conv_id, turns)``, ``turns`` as ``turns_of`` gives them."""
    keys = stage(sequences(conversations), "trie-sequences")
    # without a task count: adaptive execution gives each task its share of bytes
    rows = stage(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_trees, _NODE), "trie-nodes")
    merged = stage(merge_nodes(rows.where(F.col("kind") == PARTIAL)), "trie-shared")
    under = rows.where(F.col("kind") == UNDER_MERGED).drop("parent_conv_id", "node")
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    known = attach(under.withColumnRenamed("n_children", "_n"), parents, ["parent"], "n_children").drop("n_children").withColumnRenamed("_n", "n_children")
    shared = merged.join(parents.drop("n_children"), "parent", "left")
    complete = rows.where(F.col("kind") == COMPLETE)
    out = complete.select(*_RESULT).unionByName(known.select(*_RESULT)).unionByName(shared.select(*_RESULT))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def grafted(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation ``c`` with its first turns taken from conversation ``c - c % every``.

    ``h``, the CRC-32 of the decimal id modulo ``heads``, is how many of its own first turns give way to as
    many of the other's.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    first = conversations.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads - 1).alias("_head"))
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(heads)).cast("int")
    both = conversations.withColumn("_base", base).withColumn("_h", h).join(first, "_base", "left")
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", F.array().cast(conversations.schema["turns"].dataType)), F.lit(1), F.greatest("_h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))
