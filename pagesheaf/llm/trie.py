"""Conversation prefix trie: a z-fast trie of compacted nodes, built in batches, whose edges are expanded again.

A prefix of a conversation is named by a chained 128-bit hash of its turns, so equal prefixes have equal names and no text
moves. A compacted node stands for the depths after its parent's up to its own, and is hashed under the name of its
prefix at the two-fattest of these depths, its handle. A conversation's exit node is found by fat binary search: the
two-fattest depth of the interval still open is looked up, and a hit moves its lower end, a miss its upper end.

A task needs whole subtrees. Prefixes that more than a share of all distinct conversations have are the crown; what hangs
below it is dealt by its first prefix outside the crown, so a first turn that a third of all conversations share is no
task's burden. Each task builds a trie of its part; for the nodes of the crown it holds partial sums, which Spark adds
up. The crown has at most turns / share nodes, a bound that does not grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored

# A prefix belongs to the crown if more distinct conversations have it than CROWN and than one in CROWN_NODES of their turns.
CROWN, CROWN_NODES = 100, 200_000
# Distinct conversations a task inserts into one trie (more where one subtree has more), and those located at a time.
TRIE, BATCH = 20_000, 1_000
# Ids in one piece of a hashed list.
PIECE = 10_000
NAME = 16
ROOT = bytes(NAME)
EMPTY = hashlib.sha256(b"").hexdigest()

_TURN = "struct<digest: binary, words: int>"


def rebuilt_conversations(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """Rows (conv_id, turns): every conversation behind the first turns of the first one of its group.

    ``turns`` is a list of (digest of role and text, words of the text). Of conversation c the first h turns are those
    of c - c % group (all it has if fewer, none if it is absent), h being the CRC-32 of c in decimal modulo ``shared``;
    the turns of c after its own first h follow. Turns are in the order of ``turn``, nulls first; turns of equal
    number in the order of their digests. Null roles and texts count as empty. Rows without a ``conv_id`` belong to no
    conversation and are left out. One row holds 40 bytes for every turn of a conversation, no texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turn = F.struct("turn", F.substring(digest, 1, NAME).alias("digest"), words.alias("words"))
    own = conversations.where("conv_id is not null").select("conv_id", turn.alias("t"))
    # Structs are sorted field by field, nulls first.
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    listed = listed.select("conv_id", F.transform("t", lambda t: F.struct(t.digest, t.words)).cast(f"array<{_TURN}>").alias("turns"))
    listed = stored(listed, "conversations")
    first = listed.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(shared - 1, 1)).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    both = listed.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast(f"array<{_TURN}>")), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(lead, rest).alias("turns"))


def named_paths(rebuilt: DataFrame) -> DataFrame:
    """Rows (conv_id, name, path, words): the name of a conversation, those of all its prefixes behind each other (without
    the root's), and the words of its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, paths, words = [], [], []
            for turns in b.column(1):
                name, path = ROOT, []
                for t in turns.values.field("digest").to_pylist():
                    name = hashlib.sha256(name + t).digest()[:NAME]
                    path.append(name)
                names.append(name)
                paths.append(b"".join(path))
                words.append(turns.values.field("words").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.binary()), pa.array(paths, pa.binary()), pa.array(words, pa.list_(pa.int32()))],
                ["conv_id", "name", "path", "words"])

    return rebuilt.select("conv_id", "turns").mapInArrow(run, "conv_id bigint, name binary, path binary, words array<int>")


def distinct_paths(named: DataFrame) -> DataFrame:
    """Rows (name, path, words, n, least, ends): every distinct conversation, its copies, their smallest ``conv_id`` and hash."""
    least = F.min(F.struct("conv_id", "path", "words")).alias("x")
    once = named.groupBy("name").agg(least, F.count("*").alias("n"))
    return once.join(list_hashes(named), "name").select("name", "x.path", "x.words", "n", F.col("x.conv_id").alias("least"), "ends")


def list_hashes(members: DataFrame) -> DataFrame:
    """Rows (name, ends): SHA-256 of the ascending, comma-joined ``conv_id`` of every ``name``.

    SHA-256 runs through its input, so the last step reads a list piece by piece. The pieces of a long list are made by
    many tasks: rows are dealt by ranges of (name, id), which cut a list that a third of all rows belong to. A task holds
    one piece at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, out = None, [], []
        for b in batches:
            for n, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if n != name or len(ids) >= PIECE:
                    if ids:
                        out.append({"name": name, "first": ids[0], "piece": ",".join(map(str, ids))})
                    name, ids = n, []
                ids.append(i)
            yield pa.RecordBatch.from_pylist(out, piece_type)
            out = []
        if ids:
            out.append({"name": name, "first": ids[0], "piece": ",".join(map(str, ids))})
            yield pa.RecordBatch.from_pylist(out, piece_type)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, running = None, None
        for b in batches:
            out = []
            for n, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if n != name:
                    if running:
                        out.append({"name": name, "ends": running.hexdigest()})
                    name, running = n, hashlib.sha256(piece.encode())
                else:
                    running.update(b"," + piece.encode())
            yield pa.RecordBatch.from_pylist(out, end_type)
        if running:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends": running.hexdigest()}], end_type)

    piece_type = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
    end_type = pa.schema([("name", pa.binary()), ("ends", pa.string())])
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = members.select("name", "conv_id").repartitionByRange(tasks, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    cut = cut.mapInArrow(pieces, "name binary, first bigint, piece string")
    return cut.repartition(tasks, "name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends string")


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: the depths after its parent's ``low`` up to its own ``high`` of the path of some member."""

    __slots__ = ("children", "ends", "high", "least", "leaves", "low", "n", "parent", "path", "saved", "words")

    def __init__(self, path: list[bytes], words: list[int], low: int, high: int, parent: Node | None) -> None:
        self.path, self.words, self.low, self.high, self.parent = path, words, low, high, parent
        self.children: dict[bytes, Node] = {}
        self.n, self.least, self.ends, self.leaves, self.saved = 0, None, None, 0, 0


class ZFastTrie:
    """Compacted nodes by the names of their handles. ``path[d]`` is the name of the prefix of depth d, ``path[0]`` the root's."""

    def __init__(self) -> None:
        self.root = Node([ROOT], [], -1, 0, None)
        self.handles: dict[bytes, Node] = {}

    def locate(self, path: list[bytes]) -> Node:
        """The deepest node whose whole extent is a prefix of ``path``, by fat binary search; the exit node is it or below it."""
        node, low, high = self.root, 0, len(path) - 1
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(path[middle])
            if found is None:
                high = middle - 1
            elif found.high < len(path) and found.path[found.high] == path[found.high]:
                node, low = found, found.high
            else:
                # The path leaves the edge of this node, or ends in it.
                return found.parent
        return node

    def insert(self, batch: list[tuple[list[bytes], list[int], int, int, str | None]]) -> None:
        """Locate all of a batch in the trie as it is, then add them; new nodes are found from the located ones down."""
        for found, (path, words, n, least, ends) in zip([self.locate(b[0]) for b in batch], batch):
            # Parts of an edge that this batch has cut lie above the located node or are its children.
            self._add(found, path, words, n, least, ends)

    def _add(self, node: Node, path: list[bytes], words: list[int], n: int, least: int, ends: str | None) -> None:
        length = len(path) - 1
        while node.high < length:
            below = node.children.get(path[node.high + 1])
            if below is None:
                below = Node(path, words, node.high, length, node)
                node.children[path[node.high + 1]] = below
                self.handles[path[two_fattest(below.low, below.high)]] = below
            else:
                # Names are equal up to the depth where the paths part.
                low, high = node.high + 1, min(below.high, length)
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if below.path[middle] == path[middle] else (low, middle - 1)
                if low < below.high:
                    below = self._cut(below, low)
            node = below
        node.n += n
        node.least = least if node.least is None else min(node.least, least)
        node.ends = ends

    def _cut(self, node: Node, depth: int) -> Node:
        upper = Node(node.path, node.words, node.low, depth, node.parent)
        del self.handles[node.path[two_fattest(node.low, node.high)]]
        node.parent.children[node.path[node.low + 1]] = upper
        node.parent, node.low = upper, depth
        upper.children[node.path[depth + 1]] = node
        for x in (upper, node):
            self.handles[x.path[two_fattest(x.low, x.high)]] = x
        return upper

    def nodes(self) -> Iterator[Node]:
        """All compacted nodes, children before their parents."""
        order, stack = [], [self.root]
        while stack:
            order.append(stack.pop())
            stack.extend(order[-1].children.values())
        return reversed(order)


def expanded(trie: ZFastTrie, crown: set[bytes]) -> Iterator[tuple]:
    """(name, parent, depth, least, above, n, children, leaves, saved, ends, words, ancestors) of every prefix on every edge.

    ``above`` is the parent's ``least``, null if the parent is of the crown. Prefixes of the crown come with sums over this
    trie alone: ``children`` counts those outside the crown, ``saved`` leaves the crown out, as it needs the sums of ``n``
    over all tasks. They alone have ``words``, those of their last turn, and ``ancestors``, the names between root and them.
    """
    for node in trie.nodes():
        node.leaves = int(not node.children and node.path[node.high] not in crown)
        for child in node.children.values():
            node.n += child.n
            node.least = child.least if node.least is None else min(node.least, child.least)
            node.leaves += child.leaves
            outside = sum(name not in crown for name in child.path[child.low + 1:child.high + 1])
            # The prefixes outside the crown are the lower ones of an edge.
            node.saved += child.saved + (child.n - 1) * sum(child.words[child.high - outside:child.high])
    for node in trie.nodes():
        saved = node.saved
        for depth in range(node.high, node.low, -1):
            name, inside = node.path[depth], node.path[depth] in crown
            if not inside:
                saved += (node.n - 1) * node.words[depth - 1]
            if depth == node.high:
                children, ends = sum(c not in crown for c in node.children), node.ends
            else:
                children, ends = int(node.path[depth + 1] not in crown), None
            above, words, ancestors = None, None, None
            if inside:
                words, ancestors = node.words[depth - 1] if depth else 0, b"".join(node.path[1:depth])
            elif node.path[depth - 1] not in crown:
                above = node.least if depth - 1 > node.low else node.parent.least
            yield (name, node.path[depth - 1] if depth else None, depth, node.least, above, node.n, children, node.leaves,
                   saved, ends, words, ancestors)


def _crown(paths: DataFrame, at_least: int, nodes: int) -> list[bytes]:
    """Names of prefixes that more than ``at_least`` distinct paths and more than one in ``nodes`` of their turns have.

    The paths with a prefix of one depth have as many turns of that depth, so there are at most ``nodes`` such prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [p[i:i + NAME] for p in b.column(0).to_pylist() for i in range(0, len(p), NAME)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], ["name"])

    counts = paths.select("path").mapInArrow(run, "name binary").groupBy("name").count()
    turns = paths.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    return [bytes(r.name) for r in counts.where(F.col("count") > max(at_least, 1, turns // NAME // nodes)).select("name").collect()]


_NODE = pa.schema([
    ("name", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("least", pa.int64()), ("above", pa.int64()),
    ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
    ("words", pa.int64()), ("ancestors", pa.binary())])
_NODE_DDL = ("name binary, parent binary, depth bigint, least bigint, above bigint, n bigint, children bigint, leaves bigint, "
             "saved bigint, ends string, words bigint, ancestors binary")


def prefix_nodes(
    paths: DataFrame, crown_at: int = CROWN, crown_nodes: int = CROWN_NODES, trie_size: int = TRIE, batch: int = BATCH
) -> DataFrame:
    """Rows (name, parent, depth, least, above, n, children, leaves, saved, ends), one per distinct prefix of ``paths``.

    ``paths`` has (path, words, n, least, ends) of distinct sequences. ``above`` is the parent's ``least``.
    """
    spark = paths.sparkSession
    shared = spark.sparkContext.broadcast({ROOT, *_crown(paths, crown_at, crown_nodes)})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The crown is closed upwards, so its lower end on a path is found by halving; a path that ends in it is dealt by its name.
        for b in batches:
            keys = []
            for p in b.column(0).to_pylist():
                low, high = 0, len(p) // NAME
                while low < high:
                    middle = two_fattest(low, high)
                    low, high = (middle, high) if p[(middle - 1) * NAME:middle * NAME] in shared.value else (low, middle - 1)
                keys.append(p[low * NAME:(low + 1) * NAME] or p[-NAME:] or ROOT)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *b.columns], ["key", *b.schema.names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crown = shared.value
        held: list[tuple] = []

        def rows() -> Iterator[pa.RecordBatch]:
            trie = ZFastTrie()
            for i in range(0, len(held), batch):
                trie.insert(held[i:i + batch])
            held.clear()
            found = expanded(trie, crown)
            while out := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _NODE)], schema=_NODE)

        last = None
        for b in batches:
            for key, p, words, n, least, ends in zip(*(c.to_pylist() for c in b.columns)):
                if key != last and len(held) >= trie_size:
                    yield from rows()
                last = key
                held.append(([ROOT, *(p[i:i + NAME] for i in range(0, len(p), NAME))], words, n, least, ends))
        if held:
            yield from rows()

    dealt = paths.select("path", "words", "n", "least", "ends").mapInArrow(deal, "key binary, path binary, words array<int>, n bigint, least bigint, ends string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = stored(dealt.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(build, _NODE_DDL), "trie-nodes")

    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    kept = [F.max(c).alias(c) for c in ("ends", "words", "ancestors")]
    crown = made.where("ancestors is not null").groupBy("name", "parent", "depth")
    crown = stored(crown.agg(F.min("least").alias("least"), *sums, *kept), "crown")
    # Children inside the crown, and what prefixes of the crown save themselves, added to all of the crown above them.
    inner = crown.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("inner"))
    line = F.when(F.col("depth") == 0, F.col("name")).otherwise(F.concat(F.unhex(F.lit(ROOT.hex())), "ancestors", "name"))
    names = F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda i: F.substring(line, i * NAME + 1, F.lit(NAME)))
    own = crown.select(F.explode(names).alias("name"), ((F.col("n") - 1) * F.col("words")).alias("own"))
    own = own.groupBy("name").agg(F.sum("own").alias("own"))
    whole = crown.join(inner, "name", "left").join(own, "name")
    children = F.col("children") + F.coalesce("inner", F.lit(0))
    whole = whole.withColumns({"children": children, "leaves": F.greatest("leaves", (children == 0).cast("bigint")), "saved": F.col("saved") + F.col("own")})
    # The crown has a bounded number of rows, here of 24 bytes.
    over = F.broadcast(crown.select(F.col("name").alias("parent"), F.col("least").alias("over")))
    columns = ["name", "parent", "depth", "least", "above", "n", "children", "leaves", "saved", "ends"]
    every = made.where("ancestors is null").select(columns).union(whole.withColumn("above", F.lit(None).cast("bigint")).select(columns))
    return every.join(over, "parent", "left").withColumn("above", F.coalesce("above", "over")).select(columns)


def conversation_trie(
    conversations: DataFrame, crown_at: int = CROWN, crown_nodes: int = CROWN_NODES, trie_size: int = TRIE, batch: int = BATCH
) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations (see ``rebuilt_conversations``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the
    number of turns, the parent's smallest member (null for the root), members, children, childless nodes at or below it,
    words of repeated prefixes at or below it, and the hash of the members that end here. Equal conversations are one
    path with a count. Conversations without a turn are members of the root alone; an empty table gives no rows. A
    conversation's names (16 bytes a turn) are in one row; no text leaves the task that reads it.
    """
    named = stored(named_paths(rebuilt_conversations(conversations)), "named-conversations")
    paths = stored(distinct_paths(named), "distinct-conversations")
    nodes = prefix_nodes(paths, crown_at, crown_nodes, trie_size, batch)
    return nodes.select(
        F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
