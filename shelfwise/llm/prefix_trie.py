"""Prefix trie over conversations: one node for each distinct run of first turns, with what its subtree holds.

A turn is known by 128 bits of the SHA-256 of role and text, a node by two polynomial sums of its turns' digests modulo 2^64,
which are prefix sums along a conversation. Conversations are sorted by id into shards of ``SHARD`` turns about. A shard
enumerates the distinct prefix digests of its conversations and gives each a slot of a minimal perfect hash table
(``SlotTable``); a lookup compares the digest stored in the slot, so a collision cannot pass. Counts are scattered into flat
arrays by slot and accumulated through the array of parent slots, deepest nodes first. Two rounds over the shards:

1. members and smallest member of each node a shard sees. Spark sums them by digest; a node that all shards see is one row
   a shard. The smallest member owns the node, and what it owns is the lower end of its own path.
2. each conversation gets the whole counts of the nodes that it owns; shards accumulate the owned nodes' saved tokens,
   leaves and children up to the root, and Spark sums the parts by digest. Each node counts in one shard alone, so shards
   may cut subtrees in any way, and a first turn that a third of all conversations share is split among all of them.

The conversations that end in a node go there as ids joined up in ascending pieces; the digest over them is fed piece by
piece from sorted rows, so it needs no list.

``rebuilt`` mixes conversations beforehand: the first h turns come from the conversation that opens its hundred.

Defined cases: null role or text is empty; turns that tie come by role, then the first 32 characters and the digest of the
text; a null turn comes first; rows without conv_id belong to no conversation and are left out; repeated rows are turns of
their own; an empty table has no node, not even a root. A conversation is one row of 24 bytes a turn, so a very long one or
one of very long texts (which do not travel) fits a task. Only conv_id, turn, role and text are read, so other columns may
have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import partitions_for, read, settle, staged, stir

#: Turns that one shard holds about, and conversation ids that are joined up in one row.
SHARD, ENDS = 1 << 18, 4096
#: Conversations of one hundred share the turns of the first, at most this number less one.
HUNDRED, SHARED = 100, 6
_K = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class SlotTable:
    """A minimal perfect hash over distinct 128-bit digests: slots 0 to n - 1. Level by level a digest that is alone at its
    place gets the place's rank; the others go on to the next level. ``digests`` by slot serves to verify lookups."""

    def __init__(self, keys: np.ndarray):
        self.levels, slots, base = [], np.empty(len(keys), np.int64), 0
        left = np.arange(len(keys))
        while len(left):
            size = max(16, len(left) * 3 // 2)
            at = self._places(keys[left], size, len(self.levels))
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            hit = alone[at]
            slots[left[hit]] = rank[at[hit]]
            self.levels.append((size, alone, rank))
            base += int(np.count_nonzero(alone))
            left = left[~hit]
        self.digests = np.empty_like(keys)
        self.digests[slots] = keys

    @staticmethod
    def _places(keys: np.ndarray, size: int, level: int) -> np.ndarray:
        salt = np.uint64((int(_K) * (level + 1)) % (1 << 64))
        return (stir(keys[:, 0] + salt ^ keys[:, 1]) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each digest; an unknown one is an error."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._places(keys[left], size, level)
            hit = alone[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        if len(left) or (self.digests[out] != keys).any():
            raise ValueError("a digest has no slot")
        return out


class Shard:
    """The trie of some conversations in flat arrays by slot: digest, parent (the root's is -1), depth, chars."""

    def __init__(self, lengths: np.ndarray, turns: np.ndarray, chars: np.ndarray):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        depth = np.arange(len(turns)) - np.repeat(starts, lengths) + 1
        keys = np.empty((len(turns), 2), np.uint64)
        for k, base in enumerate(_BASES):
            power = np.full(int(lengths.max(initial=0)) + 1, base, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            total = np.zeros(len(turns) + 1, np.uint64)
            np.cumsum(turns[:, k] * power[depth], out=total[1:])
            keys[:, k] = stir(total[1:] - np.repeat(total[starts], lengths) + _K * depth.astype(np.uint64))
        root = np.zeros((1, 2), np.uint64)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        same = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = (same[1:] != same[:-1]).any(axis=1)
        self.table = SlotTable(np.concatenate([root, same[new]]))
        self.n = len(self.table.digests)
        slots = self.table.slots(keys)
        self.root = int(self.table.slots(root)[0])
        above = np.empty(len(keys), np.int64)
        above[1:] = slots[:-1]
        above[starts[lengths > 0]] = self.root
        self.parent, self.depth, self.chars = np.full(self.n, -1, np.int64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.parent[slots], self.depth[slots], self.chars[slots] = above, depth, chars
        self.slots, self.starts, self.ends = slots, starts, ends
        #: The slot in which each conversation ends.
        self.last = np.full(len(lengths), self.root)
        self.last[lengths > 0] = slots[ends[lengths > 0] - 1]
        by_depth = np.argsort(self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[by_depth])) + 1
        self.levels = np.split(by_depth, cuts)[:0:-1]

    def accumulate(self, values: np.ndarray, up=np.add) -> np.ndarray:
        """``values`` by slot, brought up from the deepest nodes to the root."""
        for level in self.levels:
            up.at(values, self.parent[level], values[level])
        return values


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """conv_ids, lengths, turn digests, chars."""
    turns = rows.column("turns").combine_chunks()
    flat = turns.flatten()
    digests = flat.field("digest")
    raw = np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)
    lengths = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.column("conv_id").to_numpy(), lengths, raw, flat.field("chars").to_numpy(zero_copy_only=False).astype(np.int64)


def _sharded(work):
    """Batches of conversations to whole shards, in order. A shard lies within one range of ids (column ``part``, if there is
    one): a task may read several ranges, in any order."""

    def run(batches):
        held, turns, part = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column("part").to_numpy() if "part" in b.schema.names else np.zeros(b.num_rows, np.int32)
            starts = np.flatnonzero(np.diff(parts, prepend=-1))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)], strict=True):
                if held and (turns >= SHARD or parts[a] != part):
                    yield from work(pa.Table.from_batches(held))
                    held, turns = [], 0
                part = parts[a]
                held.append(b.slice(a, z - a))
                turns += len(held[-1].column("turns").flatten())
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _signed(digests: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(digests[:, k]).view(np.int64) for k in (0, 1)]


_SEEN = "hi long, lo long, up_hi long, up_lo long, depth long, chars long, conv_id long, n_convs long, inner boolean, ends string"
_PARTS = "hi long, lo long, n_children long, n_leaves long, saved_tokens long"
_SEEN_NAMES = [c.split()[0] for c in _SEEN.split(", ")]


def _see(rows: pa.Table):
    conv, lengths, turns, chars = _arrays(rows)
    shard = Shard(lengths, turns, chars)
    members = np.zeros(shard.n, np.int64)
    np.add.at(members, shard.last, 1)
    smallest = np.full(shard.n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, shard.last, conv)
    shard.accumulate(members)
    shard.accumulate(smallest, np.minimum)
    inner = np.zeros(shard.n, bool)
    inner[shard.parent[shard.parent >= 0]] = True
    (hi, lo), up = _signed(shard.table.digests), shard.parent
    none = pa.nulls(shard.n, pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi, lo, hi[up], lo[up], shard.depth, shard.chars, smallest, members, inner)] + [none], names=_SEEN_NAMES)
    # Conversations that end in a slot, in ascending order
    order = np.lexsort((conv, shard.last))
    cuts = np.flatnonzero(np.diff(shard.last[order])) + 1
    out = []
    for group in np.split(order, cuts):
        slot = shard.last[group[0]]
        for at in range(0, len(group), ENDS):
            ids = conv[group[at : at + ENDS]].tolist()
            out.append((int(hi[slot]), int(lo[slot]), ids[0], ",".join(map(str, ids))))
    a, b, first, text = zip(*out, strict=True)
    fixed = {"hi": pa.array(a, pa.int64()), "lo": pa.array(b, pa.int64()), "conv_id": pa.array(first, pa.int64()), "ends": pa.array(text, pa.string())}
    yield pa.RecordBatch.from_arrays([fixed[c] if c in fixed else pa.nulls(len(out), pa.bool_() if c == "inner" else pa.int64()) for c in _SEEN_NAMES], names=_SEEN_NAMES)


def _sum_up(rows: pa.Table):
    _, lengths, turns, chars = _arrays(rows)
    shard = Shard(lengths, turns, chars)
    saved, leaves, children = (np.zeros(shard.n, np.int64) for _ in range(3))
    owned = rows.column("owned").combine_chunks()
    flat = owned.flatten()
    n = owned.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # What a conversation owns is the lower end of its path; a path counts from the root, which has no turn
    depth = flat.field("depth").to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(n)), n)
    slot = np.full(len(depth), shard.root)
    below = depth > 0
    slot[below] = shard.slots[shard.starts[of[below]] + depth[below] - 1]
    saved[slot] = flat.field("saved").to_numpy(zero_copy_only=False)
    leaves[slot] = flat.field("leaf").to_numpy(zero_copy_only=False)
    np.add.at(children, shard.parent[slot[below]], 1)
    shard.accumulate(saved), shard.accumulate(leaves)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*_signed(shard.table.digests), children, leaves, saved)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _digest_ends(batches):
    """Rows (hi, lo, ends) in order to one digest a node."""
    key, digest = None, None
    for b in batches:
        out = []
        for hi, lo, text in zip(*(b.column(c).to_pylist() for c in ("hi", "lo", "ends")), strict=True):
            if (hi, lo) != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (hi, lo), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
        yield _end_batch(out)
    if key:
        yield _end_batch([(*key, digest.hexdigest())])


def _end_batch(rows: list[tuple]) -> pa.RecordBatch:
    cells = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["hi", "lo", "ends_sha256"])


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the digest and the code points of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps ("ab", "c") and ("a", "bc") apart
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.left(text, F.lit(32)).alias("begin"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("turn"))
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.chars.alias("chars"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation c begins with the first h turns of c - c % 100 (all if fewer, none if it is absent) in the place of its
    own first h; h = crc32 of c in decimal, modulo 6. At most a hundred conversations ask for one."""
    opens = F.col("conv_id") % HUNDRED == 0
    heads = lists.where(opens).select(F.col("conv_id").alias("opening"), F.slice("turns", 1, SHARED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.size("turns"))
    return lists.join(heads, F.col("conv_id") - F.col("conv_id") % HUNDRED == F.col("opening"), "left").select("conv_id", F.concat(head, own).alias("turns"))


def prefix_trie(lists: DataFrame, turns: int = 0) -> DataFrame:
    """(conv_id, turns), one row a conversation, to one row a node: hi, lo (its digest), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. ``turns``: how many there are about, for the
    number of ranges."""
    spark = lists.sparkSession
    ranges = partitions_for(spark, turns // (4 * SHARD))
    dealt = lists.repartitionByRange(ranges, "conv_id").sortWithinPartitions("conv_id").withColumn("part", F.spark_partition_id())
    lists = staged(dealt, "op12-conversations")
    seen = staged(lists.mapInArrow(_sharded(_see), _SEEN), "op12-seen")
    same = [F.max(c).alias(c) for c in ("up_hi", "up_lo", "depth", "chars")]  # equal in all parts of a node
    nodes = seen.where("ends is null").groupBy("hi", "lo").agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("inner").alias("inner"))
    nodes = staged(nodes, "op12-nodes")

    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    owned = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.collect_list(F.struct("depth", saved, (~F.col("inner")).cast("long").alias("leaf"))).alias("owned"))
    parts = lists.join(owned, F.col("conv_id") == F.col("owner")).select("conv_id", "turns", "owned").mapInArrow(_sharded(_sum_up), _PARTS)

    ends = seen.where("ends is not null").select("hi", "lo", "conv_id", "ends").repartition("hi", "lo").sortWithinPartitions("hi", "lo", "conv_id")
    ends = ends.select("hi", "lo", "ends").mapInArrow(_digest_ends, "hi long, lo long, ends_sha256 string")
    facts, sums = ["depth", "conv_id", "n_convs", "up_hi", "up_lo"], ["n_children", "n_leaves", "saved_tokens"]
    together = nodes.select("hi", "lo", *facts).unionByName(parts, allowMissingColumns=True).groupBy("hi", "lo").agg(*(F.max(c).alias(c) for c in facts), *(F.sum(c).alias(c) for c in sums))
    done = together.join(ends, ["hi", "lo"], "left")
    # The parent of a node that its owner's path enters from another owner's; the rest have their own owner as parent's
    above = nodes.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"))
    out = done.join(above, ["up_hi", "up_lo"], "left")
    return out.select(
        "hi", "lo", "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        *sums, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    conversations = read(spark, sf_dir, "conversations")
    return prefix_trie(rebuilt(turn_lists(conversations)), conversations.count()).drop("hi", "lo")


OP12_SQL = """
WITH lists AS (
  SELECT conv_id, list({'k': md5(length(r) || ':' || r || t), 'n': length(t)} ORDER BY turn NULLS FIRST, r, t) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
), cuts AS (
  SELECT conv_id, turns, list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc FROM lists
), rebuilt AS (
  SELECT c.conv_id, coalesce(o.turns, [])[1:h] || c.turns[h + 1:] AS turns
  FROM (SELECT conv_id, turns, xor(crc, 4294967295) % 6 AS h FROM cuts) c LEFT JOIN lists o ON o.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, list_transform(turns[1:d], lambda x: x.k) AS path, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS chars, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), subtrees AS (
  SELECT n.path[1:n.k] AS path, sum((n.n - 1) * n.chars) AS saved, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT path, n, chars, unnest(range(0, d + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.path = n.path
  GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN subtrees s ON s.path = n.path LEFT JOIN children c ON c.path = n.path
LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
