"""Conversation prefix trie (operator 13): shared prefixes of conversations, in balanced parentheses per shard.

A conversation is a path of turn digests (128 bits of SHA-256 over role and text). Paths are dealt out and sorted by
range, so a task meets them in the trie's depth-first order and equal ones beside each other; a first turn or a whole
conversation that very many share is cut like anything else. A task builds one shard after another, each of a
bounded number of turns: the trie's depths in preorder give a balanced-parentheses sequence, ``findclose`` over a range
min-max tree of its excess delimits every subtree, ranks of leaf pairs count leaves, and cumulative arrays
give members and savings.

Only the first and the last path of a shard can go on in another one. These spines leave the shard with what hangs off them
summed up; ``FAN`` partitions' spines merge in one task into a trie of the same form, whose own first and last path go on,
until one trie is left. So a merge sees a shard's depth, never its nodes. A node's digest of members is taken in the shard; that of
a spine node streams over pieces of text, in order, from all its shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C

#: Turns and conversations of a shard, about; a conversation is never cut.
SHARD_ENTRIES = 200_000
#: Partitions (or merged groups of them) whose spines one task merges.
FAN = 256
#: Positions of a block of the excess.
BLOCK = 64
#: Bytes of a turn's digest and of a node's id.
WIDTH = 16
#: Ids of members in a piece of text that is hashed elsewhere.
PIECE = 8192

NODE, SPINE, ENDS = 0, 1, 2
ROOT = bytes(WIDTH)
NO_MEMBER = np.iinfo(np.int64).max
PARTS = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "node binary, parent binary, pid int, sub int, seq int, chars long, ids string"
)
OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in PARTS.split(","))])


class Parens:
    """The balanced parentheses of an ordered tree, given its nodes' depths in preorder."""

    def __init__(self, depths: np.ndarray):
        n = len(depths)
        self.opens = np.arange(n) + np.concatenate([[0], np.cumsum(depths[:-1] - depths[1:] + 1)]).astype(np.int64)
        self.bits = np.zeros(2 * n, bool)
        self.bits[self.opens] = True
        blocks = 1 << max(0, (-(-2 * n // BLOCK) - 1).bit_length())
        excess = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        excess[: 2 * n] = np.cumsum(np.where(self.bits, 1, -1))
        self.excess = excess.reshape(-1, BLOCK)
        self.levels = [self.excess.min(1)]  # least excess of a block, of two, of four ...
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(1))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The position of the parenthesis that closes each of ``at``: the first later one of less excess."""
        return np.concatenate([self._findclose(at[i : i + 16384]) for i in range(0, len(at), 16384)] or [at])

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        block, want = at // BLOCK, self.excess.reshape(-1)[at]
        place = self._within(block, at % BLOCK + 1, want)
        far = np.flatnonzero(place < 0)
        block[far] = self._next_block(block[far] + 1, want[far])
        place[far] = self._within(block[far], np.zeros(len(far), np.int64), want[far])
        return block * BLOCK + place

    def _within(self, block: np.ndarray, begin: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place of a block from ``begin`` on where the excess is below ``want``, or -1."""
        hit = (self.excess[block] < want[:, None]) & (np.arange(BLOCK) >= begin[:, None])
        return np.where(hit.any(1), hit.argmax(1), -1)

    def _next_block(self, block: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first block from ``block`` on whose least excess is below ``want``: up and to the right, then down."""
        found, top = np.full(len(block), -1), len(self.levels) - 1
        for level, low in enumerate(self.levels):
            search = found < 0
            hit = search & ((level == top) | (block % 2 == 1) & (low[np.minimum(block, len(low) - 1)] < want))
            found[hit] = level
            block = np.where(search & ~hit, (block + 1) >> 1, block)
        for level in range(top - 1, -1, -1):
            low = self.levels[level]
            block = np.where(found > level, 2 * block + (low[np.minimum(2 * block, len(low) - 1)] >= want), block)
        return block

    def pairs(self) -> np.ndarray:
        """Whether each position begins a pair, that is a leaf."""
        return self.bits & ~np.concatenate([self.bits[1:], [True]])


class _Trie:
    """Nodes in preorder: of each what it brings itself, and what hangs off it in tries merged before."""

    def __init__(self):
        self.depth, self.parent, self.node, self.chars = [0], [-1], [ROOT], [0]
        self.sums = {n: [0] for n in ("n", "children", "leaves", "saved")}
        self.least = [NO_MEMBER]
        self.path = [0]

    def down(self, k: int, node: bytes, chars: int) -> int:
        """The child ``node`` of the current path's node of depth k - 1, new unless it is the path's own; the path then ends there."""
        if k < len(self.path) and self.node[self.path[k]] == node:
            return self.path[k]
        del self.path[k:]
        self.depth.append(k)
        self.parent.append(self.path[-1])
        self.node.append(node)
        self.chars.append(chars)
        self.least.append(NO_MEMBER)
        for x in self.sums.values():
            x.append(0)
        self.path.append(len(self.node) - 1)
        return self.path[-1]

    def parts(self, pid: int, sub: int, last: bool, members: dict[int, list[int]] | None = None) -> pa.RecordBatch:
        """Rows of all nodes: finished ones, and the spines with what hangs off them. members: of nodes, in a trie of conversations."""
        count = len(self.node)
        depth, parent, chars = (np.array(x, np.int64) for x in (self.depth, self.parent, self.chars))
        n, children, leaves, saved = (np.array(self.sums[x], np.int64) for x in ("n", "children", "leaves", "saved"))
        least = np.array(self.least, np.int64)
        tree = Parens(depth)
        close = tree.findclose(tree.opens)
        end = np.arange(count) + (close - tree.opens + 1) // 2  # of a node's subtree, in preorder
        subtree = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[:-1]
        spine = np.zeros(count, bool)
        if not last:
            spine[: int(np.argmax(np.append(np.diff(depth), 0) != 1)) + 1] = True
            spine[self.path] = True
        if members is not None:  # what a merged trie already has for each node
            n = subtree(n)
            by_depth = np.argsort(-depth, kind="stable")
            for level in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
                if depth[level[0]]:
                    np.minimum.at(least, parent[level], least[level])
        pair = tree.pairs()
        pair[tree.opens[children > 0]] = False
        rank = np.concatenate([[0], np.cumsum(pair)])
        n_leaves = rank[close] - rank[tree.opens] + subtree(leaves)
        n_saved = subtree(saved + np.where(spine, 0, (n - 1) * chars))
        kids = np.bincount(parent[1:], minlength=count) if count > 1 else np.zeros(count, np.int64)
        n_children = children + kids
        hung = np.flatnonzero(~spine)
        hung = hung[parent[hung] >= 0]
        hung = hung[spine[parent[hung]]]
        for own, what in ((children, np.ones(count, np.int64)), (leaves, n_leaves), (saved, n_saved)):
            np.add.at(own, parent[hung], what[hung])
        rows = []
        for i in range(count):
            up = parent[i]
            if spine[i]:
                rows.append((SPINE, least[i], depth[i], None, n[i], children[i], leaves[i], saved[i], None, self.node[i], self.node[up] if up >= 0 else None, pid, sub, i, chars[i], None))
                own = (members or {}).get(i, ())
                rows += [(ENDS, *[None] * 8, self.node[i], None, pid, sub, k, None, ",".join(map(str, own[k : k + PIECE]))) for k in range(0, len(own), PIECE)]
            else:
                known = up >= 0 and not spine[up]
                ends = None if members is None else sha256(",".join(map(str, members.get(i, ()))).encode()).hexdigest()
                rows.append((NODE, least[i], depth[i], least[up] if known else None, n[i], n_children[i], n_leaves[i], n_saved[i], ends, self.node[i], None if known or up < 0 else self.node[up], pid, sub, i, None, None))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _shards(entries: int):
    """Tries of sorted conversations, one after another, of about ``entries`` turns and conversations each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, sub, size, trie, members = TaskContext.get().partitionId(), 0, 0, None, {}
        for b in batches:
            for path, chars, conv in zip(*(b.column(n).to_pylist() for n in ("path", "chars", "conv_id")), strict=True):
                if trie is None:
                    trie, members, size = _Trie(), {}, 0
                at, node = 0, ROOT
                for k, c in enumerate(chars):
                    node = blake2b(node + path[k * WIDTH : (k + 1) * WIDTH], digest_size=WIDTH).digest()
                    at = trie.down(k + 1, node, c)
                trie.sums["n"][at] += 1
                trie.least[at] = min(trie.least[at], conv)
                members.setdefault(at, []).append(conv)
                size += 1 + len(chars)
                if size >= entries:
                    yield trie.parts(pid, sub, False, members)
                    trie, sub = None, sub + 1
        if trie is not None:
            yield trie.parts(pid, sub, False, members)

    return run


def _merged(last: bool):
    """Merges the spines of neighbouring shards, which come in the order of their nodes."""

    def run(key, table):
        table = table.sort_by([("pid", "ascending"), ("sub", "ascending"), ("seq", "ascending")])
        trie = _Trie()
        names = ("depth", "node", "chars", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        for depth, node, chars, least, *sums in zip(*(table.column(n).to_pylist() for n in names), strict=True):
            at = trie.down(depth, node, chars) if depth else 0
            trie.least[at] = min(trie.least[at], least)
            for own, x in zip(trie.sums.values(), sums, strict=True):
                own[at] += x
        return pa.Table.from_batches([trie.parts(key[0].as_py(), 0, last)])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's members, from pieces of text that come in order."""
    now = text = None

    def done():
        return pa.RecordBatch.from_pydict({"node": pa.array([now], pa.binary()), "ends": [text.hexdigest()]})

    for b in batches:
        for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    yield done()
                now, text = node, sha256()
            else:
                text.update(b",")
            text.update(ids.encode())
    if now is not None:
        yield done()


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the conversation's turns in order, each its digest and the code points of its text.

    ``turns`` has conv_id, turn, role, text. They are ordered by turn (null first), equal ones by their digest; a null role or text is empty; rows of a
    null conv_id belong to no conversation. A row is one conversation, of some 40 bytes a turn, whatever its texts' lengths.
    """
    t = C.only(turns, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    one = F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    every = t.select("conv_id", one.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return every.select("conv_id", F.transform("x", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations c whose first h turns come from conversation c - c % ``every``, h being the crc32 of c's decimals modulo ``most``.

    All of that one's turns if it has fewer, none if it is not there; then c's own turns after its first h. Without turns it is still a conversation.
    """
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h"), "turns")
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return own.join(base, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def prefix_trie(convs: DataFrame, entries: int = SHARD_ENTRIES, fan: int = FAN) -> DataFrame:
    """The nodes of the trie of all conversations: OUT, as the contract names them.

    ``convs`` has conv_id, not null and unique, and turns as ``turn_arrays`` makes them; other columns are ignored. Equal conversations are one
    path with several members; one without turns ends at the root; no conversation at all gives no row, not even a root. Saved tokens are code points:
    of each node's text, once for every member but the first.
    """
    path = F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")), F.lit(b""))
    paths = C.written(convs.select("conv_id", path.alias("path"), F.col("turns.chars").alias("chars")))
    C.small_batches(convs.sparkSession)
    cut = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    first = C.written(cut.mapInArrow(_shards(entries), PARTS))
    tables, spines, n = [paths, first], first.where(f"kind = {SPINE}"), first.agg(F.max("pid")).first()[0]
    merged = []
    while n is not None:
        n //= fan
        level = C.written(spines.groupBy((F.col("pid") / fan).cast("int")).applyInArrow(_merged(n == 0), PARTS))
        merged.append(level)
        spines = level.where(f"kind = {SPINE}")
        if n == 0:
            break
    nodes = first.where(f"kind = {NODE}")
    if not merged:
        return nodes.select(*OUT)
    late = merged[0]
    for level in merged[1:]:
        late = late.unionByName(level)
    late = late.where(f"kind = {NODE}")
    known = late.select("node", F.col("conv_id").alias("known"))
    ends = first.where(f"kind = {ENDS}").select("node", "pid", "sub", "seq", "ids").repartition("node").sortWithinPartitions("node", "pid", "sub", "seq")
    late = late.drop("ends_sha256").join(ends.drop("pid", "sub", "seq").mapInArrow(_hashed, "node binary, ends string"), "node", "left")
    late = late.join(known.withColumnRenamed("node", "parent"), "parent", "left").withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "known"), "ends_sha256": F.coalesce("ends", F.lit(sha256(b"").hexdigest()))})
    spined = first.where(f"kind = {SPINE}").select("pid", "sub", "node").join(known, "node").withColumnRenamed("node", "parent")
    hung = nodes.where("parent IS NOT NULL").drop("parent_conv_id").join(spined, ["pid", "sub", "parent"]).withColumnRenamed("known", "parent_conv_id")
    out = C.written(nodes.where("parent IS NULL").select(*OUT).unionByName(hung.select(*OUT)).unionByName(late.select(*OUT)))
    C.forget(*tables, *merged)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``, each rebuilt on its hundred's first one; see ``turn_arrays``, ``rebuilt`` and ``prefix_trie`` for nulls and ties."""
    return prefix_trie(rebuilt(turn_arrays(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP13_SQL = """
WITH t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS d
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(length(text) ORDER BY turn NULLS FIRST, d) AS ls FROM t GROUP BY c),
bits AS (SELECT c, list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS b FROM own),
h AS (SELECT c, (xor(4294967295::BIGINT, list_reduce(b, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 6)::BIGINT AS h FROM bits),
r AS (SELECT own.c, coalesce(base.ds[1:h], []) || own.ds[h + 1:] AS ds, coalesce(base.ls[1:h], []) || own.ls[h + 1:] AS ls
      FROM own JOIN h USING (c) LEFT JOIN own base ON base.c = own.c - own.c % 100),
p AS (SELECT c, len(ds) AS n, ls, array_to_string(ds, '') AS path, unnest(range(0, len(ds) + 1)) AS depth FROM r),
nodes AS (SELECT path[:32 * depth] AS node, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN ls[depth] ELSE 0 END) AS chars,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
          FROM p GROUP BY 1, 2),
kids AS (SELECT node[:32 * (depth - 1)] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT node[:32 * k] AS top, n.node, (n_convs - 1) * chars AS own, (node NOT IN (SELECT node FROM kids))::BIGINT AS leaf
       FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) n),
sums AS (SELECT top AS node, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes u ON n.depth > 0 AND u.node = n.node[:32 * (n.depth - 1)]
"""
