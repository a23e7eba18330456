"""Trie of rebuilt conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns (role, text). Its digest is the sum,
lane by lane modulo 2^32, of the hashes of (place, turn) over its turns, so that the
digests along a conversation are running sums, which tasks compute for their own
stretch of a conversation and shift by what the stretches before it add up to: a
conversation with a third of all rows is many stretches. Nodes are enumerated by one
aggregation with partial sums; there every member's parent digest and last turn (128
further bits) must agree, which by induction makes equal digests equal sequences.

Subtrees are summed in shards. A node's weight is the number of turns of its members
from it on, which bounds the nodes below it. The nodes of a subtree of weight up to
``limit`` go to one shard (that of the subtree's top), so a first turn shared by a
third of all conversations is dealt out over many shards. In a shard, levels of bits
give each digest its slot in a minimal perfect hash; a looked-up slot counts only if
the digest stored there is equal. Counts are scattered into flat arrays and added
through the array of parent slots, deepest turns first. The few heavier nodes above
get the sums of the subtrees below them, and are dealt and summed in the same way in
rounds of growing weight: a round's subtree holds at most max(limit, 2 x depth) nodes.

Rebuilding: conversation c gets the first h turns of conversation c - c % ``GROUP``
(all if it has fewer, none if it is absent) and then its own turns behind its first h,
h = crc32(decimal c) % ``SHARED``. Places of turns come from a range sort by
conversation, turn (null first) and the digest of role and text.

Digests of members' ids: sorted ids are joined into strings by all tasks; one pass
over those strings, in order, is left to the SHA-256 of each node, which is sequential.

Defined results: a null role or text is empty; turns with equal numbers are ordered by
the digest of role and text, repeated rows are turns of their own; rows with a null
conv_id belong to no conversation and are left out; a conversation that keeps no turn
ends at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, read, stored

GROUP, SHARED = 5, 9
#: Nodes of a subtree that one shard sums at once.
LIMIT = 1 << 16
#: Ids in one string of the digests of members.
IDS = 4096
LANES = 4
MASK = 0xFFFFFFFF


# --- places and prefix digests -------------------------------------------------------------

def _runs(conv: np.ndarray, last: int | None) -> tuple[np.ndarray, bool]:
    """The first index of the run each row is in, and whether the first run continues ``last``."""
    new = np.r_[True, conv[1:] != conv[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0)), last is not None and conv[0] == last


def _stretches(batches):
    """Numbers each conversation's turns within this task's sorted rows."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if b.num_rows:
            conv = b.column("conv_id").to_numpy()
            start, goes_on = _runs(conv, last)
            place = np.arange(len(conv)) - start + (seen * (start == 0) if goes_on else 0)
            last, seen = conv[-1], int(place[-1]) + 1
            yield pa.record_batch([b.column("conv_id"), b.column("turn_sha"), b.column("bytes"), pa.array(place),
                                   pa.array(np.full(len(conv), part))], ["conv_id", "turn_sha", "bytes", "place", "part"])


def _sums(batches):
    """Running sums of the turns' hashes within this task's sorted rows: s0.. with the turn, o0.. its own."""
    part, last, held = TaskContext.get().partitionId(), None, None
    for b in batches:
        if b.num_rows:
            conv = b.column("conv_id").to_numpy()
            own = np.frombuffer(b"".join(b.column("hash").to_pylist()), ">u4").reshape(len(conv), -1)[:, :LANES].astype(np.int64)
            start, goes_on = _runs(conv, last)
            total = np.cumsum(own, axis=0)
            here = total - (total - own)[start]
            if goes_on:
                here[start == 0] += held
            here &= MASK
            last, held = conv[-1], here[-1]
            kept = ["conv_id", "depth", "length", "bytes", "t1", "t2"]
            yield pa.record_batch([*map(b.column, kept), pa.array(np.full(len(conv), part)), *[pa.array(here[:, i].copy()) for i in range(LANES)],
                                   *[pa.array(own[:, i].copy()) for i in range(LANES)]],
                                  [*kept, "part", *[f"s{i}" for i in range(LANES)], *[f"o{i}" for i in range(LANES)]])


def _word(hexes: Column, at: int) -> Column:
    """64 of the bits of a hex digest as a long."""
    half = [F.conv(F.substring(hexes, at + k, 8), 16, 10).cast("long") for k in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


def original_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_sha, bytes and place (from 0) of every turn."""
    rows = columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = rows.select(F.col("conv_id").cast("long"), "turn", sha.alias("turn_sha"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "turn", "turn_sha"]
    turns = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _stretches, "conv_id long, turn_sha string, bytes long, place long, part long"), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select(
        "conv_id", "part", F.sum("n").over(before).alias("shift")).where("shift IS NOT NULL")
    return turns.join(shifts, ["conv_id", "part"], "left").select(
        "conv_id", "turn_sha", "bytes", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every rebuilt conversation and its turns: conv_id, depth, length, bytes, turn_sha."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("donor"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).alias("h"))
    given = own.select(F.col("conv_id").alias("donor"), F.col("n").alias("m"))
    convs = stored(own.join(given, "donor", "left").withColumn("k", F.least("h", F.coalesce("m", F.lit(0)))).select(
        "conv_id", "donor", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    kept = turns.join(convs, "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("k") + 1).alias("depth"), "length", "bytes", "turn_sha")
    first = turns.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "donor")
    got = first.join(convs, "donor").where("place < k").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "length", "bytes", "turn_sha")
    return convs.select("conv_id", "length"), kept.union(got)


def prefixes(turns: DataFrame) -> DataFrame:
    """The rebuilt turns with the digests (hi, lo) of the node that each reaches and (phi, plo) of its parent."""
    place = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_sha")), 256)
    rows = turns.select("conv_id", "depth", "length", "bytes", _word(F.col("turn_sha"), 0).alias("t1"),
                        _word(F.col("turn_sha"), 16).alias("t2"), F.unhex(place).alias("hash"))
    lanes = [f"{x}{i} long" for x in "so" for i in range(LANES)]
    local = stored(rows.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").mapInArrow(
        _sums, "conv_id long, depth long, length long, bytes long, t1 long, t2 long, part long, " + ", ".join(lanes)), "trie-sums")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("conv_id", "part").agg(F.max("depth").alias("depth"))
    split = Window.partitionBy("conv_id")
    ends = ends.withColumn("parts", F.count("*").over(split)).where("parts > 1").drop("parts")
    shifts = local.join(ends, ["conv_id", "part", "depth"]).select(
        "conv_id", "part", *[F.sum(f"s{i}").over(before).alias(f"x{i}") for i in range(LANES)]).where("x0 IS NOT NULL")
    rows = local.join(shifts, ["conv_id", "part"], "left")

    def pair(back: bool) -> list[Column]:
        lane = [(F.col(f"s{i}") + F.coalesce(f"x{i}", F.lit(0)) - (F.col(f"o{i}") if back else 0)).bitwiseAND(F.lit(MASK)) for i in range(LANES)]
        return [F.shiftleft(lane[i], 32).bitwiseOR(lane[i + 1]) for i in (0, 2)]

    (hi, lo), (phi, plo) = pair(False), pair(True)
    return rows.select("conv_id", "depth", "length", "bytes", "t1", "t2", hi.alias("hi"), lo.alias("lo"), phi.alias("phi"), plo.alias("plo"))


# --- nodes ---------------------------------------------------------------------------------

def nodes_of(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per node below and at the root; fails if members of a digest differ."""
    same = F.lit(True)
    for c in ("depth", "phi", "plo", "t1", "t2", "bytes"):
        same &= F.min(c) == F.max(c)
    same &= (F.max("hi") != 0) | (F.max("lo") != 0)
    members = F.when(same, F.count("*")).otherwise(F.raise_error("two sequences of turns have the same digest").cast("long"))
    found = paths.groupBy("hi", "lo").agg(
        F.max("phi").alias("phi"), F.max("plo").alias("plo"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        members.alias("n_convs"), F.count_if(F.col("depth") == F.col("length")).alias("n_ends"), F.max("bytes").alias("bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("length") == 0).alias("n_ends"),
                     F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    root = root.select(zero.alias("hi"), zero.alias("lo"), none.alias("phi"), none.alias("plo"), zero.alias("depth"),
                       "conv_id", "n_convs", "n_ends", zero.alias("bytes"), "weight")
    return found.unionByName(root)


def thresholds(most: int, deep: int, limit: int) -> list[int]:
    """Weights up to which a round's subtrees go, the last at least ``most``."""
    out, factor = [limit], max(2, limit // max(deep, 1))
    while out[-1] < most:
        out.append(out[-1] * factor)
    return out


def placed(nodes: DataFrame, paths: DataFrame, steps: list[int]) -> DataFrame:
    """The nodes with their round and the digest of the top of their subtree in that round.

    Weights fall along a path, so the top is where the parent's round is a later one;
    a node's path is that of its smallest member."""
    late = sum((F.when(F.col("weight") > t, 1).otherwise(0) for t in steps), F.lit(0))
    nodes = nodes.withColumn("round", late)
    heavy = nodes.where("round > 0").select("hi", "lo", "round")
    above = heavy.select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("round").alias("p_round"))
    tops = paths.select("conv_id", "hi", "lo", "phi", "plo").join(above, ["phi", "plo"]).join(heavy, ["hi", "lo"], "left")
    tops = tops.withColumn("round", F.coalesce("round", F.lit(0))).where("round < p_round").select(
        "conv_id", "round", F.col("hi").alias("top_hi"), F.col("lo").alias("top_lo"))
    zero = F.lit(0).cast("long")
    return nodes.join(tops, ["conv_id", "round"], "left").withColumns(
        {"top_hi": F.coalesce("top_hi", zero), "top_lo": F.coalesce("top_lo", zero)})


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: at each level the keys that are alone at their bit stay there,
    the others go on; a slot is the number of bits before. ``slots`` gives -1 for a key that is not held."""

    def __init__(self, keys: np.ndarray):
        self.levels, self.keys, left, base = [], np.empty_like(keys), keys, 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys are not distinct")
            size = max(8, len(left) * 3 // 2)
            at = self._hash(left, len(self.levels)) % np.uint64(size)
            bits = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append((size, bits, base + np.cumsum(bits) - 1))
            alone = bits[at]
            self.keys[self.levels[-1][2][at[alone]]] = left[alone]
            base, left = base + int(bits.sum()), left[~alone]

    @staticmethod
    def _hash(keys: np.ndarray, level: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1), np.ones(len(keys), bool)
        for level, (size, bits, ranks) in enumerate(self.levels):
            at = self._hash(keys, level) % np.uint64(size)
            hit = open_ & bits[at]
            out[hit] = ranks[at[hit]]
            open_ &= ~hit
        held = out >= 0
        held[held] = (self.keys[out[held]] == keys[held]).all(axis=1)
        return np.where(held, out, -1)


FILLED = ("hi long, lo long, phi long, plo long, depth long, conv_id long, parent_conv_id long, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, loose boolean")


def fill(shard: pa.Table) -> pa.Table:
    """Sums of one shard: flat arrays by slot, added to the parents' slots from the deepest turn up."""
    def column(name: str) -> np.ndarray:
        return shard.column(name).fill_null(0).to_numpy()

    def keys(*names: str) -> np.ndarray:
        return np.stack([column(n).astype(np.int64).view(np.uint64) for n in names], axis=1)

    table = PerfectHash(keys("hi", "lo"))
    slot = table.slots(keys("hi", "lo"))
    parent, depth, conv, children, leaves, saved = (np.empty(len(slot), np.int64) for _ in range(6))
    up = table.slots(keys("phi", "plo"))
    parent[slot] = np.where(column("depth") > 0, up, -1)
    depth[slot], conv[slot], children[slot] = column("depth"), column("conv_id"), column("g_children")
    leaves[slot] = (column("n_ends") == column("n_convs")) + column("g_leaves")
    saved[slot] = (column("n_convs") - 1) * column("bytes") + column("g_saved")
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        for sums, what in ((children, 1), (leaves, leaves[level]), (saved, saved[level])):
            np.add.at(sums, parent[level], what)
    inside = parent[slot] >= 0
    of_parent = pa.array(conv[parent[slot]], mask=~inside)
    same = [shard.column(n) for n in ("hi", "lo", "phi", "plo", "depth", "conv_id")]
    return pa.table([*same, of_parent, shard.column("n_convs"), *[pa.array(x[slot]) for x in (children, leaves, saved)], pa.array(~inside)],
                    [c.split()[0] for c in FILLED.split(", ")])


# --- members that end at a node --------------------------------------------------------------

def _joined(batches):
    """Sorted (hi, lo, conv_id) as comma-joined strings of up to IDS ids of one node."""
    node, ids = None, []

    def out():
        return pa.record_batch([pa.array([node[0]]), pa.array([node[1]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])],
                               ["hi", "lo", "first", "ids"])
    for b in batches:
        made = []
        for hi, lo, conv in zip(*(b.column(n).to_pylist() for n in ("hi", "lo", "conv_id"))):
            if node != (hi, lo) or len(ids) == IDS:
                if node is not None:
                    made.append(out())
                node, ids = (hi, lo), []
            ids.append(conv)
        if made:
            yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    if node is not None:
        yield out()


def _hashed(batches):
    """SHA-256 of each node's strings in order."""
    node, sha = None, None
    for b in batches:
        made = []
        for hi, lo, ids in zip(*(b.column(n).to_pylist() for n in ("hi", "lo", "ids"))):
            if node != (hi, lo):
                if node is not None:
                    made.append((*node, sha.hexdigest()))
                node, sha = (hi, lo), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if made:
            yield pa.record_batch([pa.array(x) for x in zip(*made)], ["hi", "lo", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([x]) for x in (*node, sha.hexdigest())], ["hi", "lo", "ends_sha256"])


def ends_of(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256 of the nodes where a member ends."""
    zero = F.lit(0).cast("long")
    ended = paths.where("depth = length").select("hi", "lo", "conv_id").union(
        convs.where("length = 0").select(zero, zero, "conv_id"))
    order = ["hi", "lo", "conv_id"]
    strings = ended.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "hi long, lo long, first long, ids string")
    return strings.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").mapInArrow(
        _hashed, "hi long, lo long, ends_sha256 string")


# --- the trie ----------------------------------------------------------------------------------

def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes: hi, lo (digest), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (null where no member ends)."""
    convs, turns = rebuilt_turns(original_turns(conversations))
    paths = stored(prefixes(turns), "trie-paths")
    nodes = stored(nodes_of(convs, paths), "trie-nodes")
    most, deep = nodes.agg(F.coalesce(F.max("weight"), F.lit(0)), F.max(F.when(F.col("weight") > limit, F.col("depth")))).first()
    steps = thresholds(most, deep or 0, limit)
    dealt = stored(placed(nodes, paths, steps), "trie-placed")
    sizes = dict(dealt.groupBy("round").count().collect())  # a row a round
    done = None
    for step in sorted(sizes):
        here = dealt.where(F.col("round") == step)
        if done is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in ("g_children", "g_leaves", "g_saved")})
        else:
            gifts = done.where("loose").groupBy(F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(
                F.count("*").alias("g_children"), F.sum("n_leaves").alias("g_leaves"), F.sum("saved_tokens").alias("g_saved"))
            here = here.join(gifts, ["hi", "lo"], "left")
        shard = F.pmod(F.xxhash64("top_hi", "top_lo"), F.lit(-(-sizes[step] // limit)))
        filled = stored(here.withColumn("shard", shard).groupBy("shard").applyInArrow(fill, FILLED), "trie-filled")
        done = filled if done is None else done.unionByName(filled)
    if done is None:
        done = conversations.sparkSession.createDataFrame([], FILLED)
    heavy = nodes.where(F.col("weight") > limit).select(F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("p_conv"))
    return done.join(heavy, ["phi", "plo"], "left").join(ends_of(convs, paths), ["hi", "lo"], "left").select(
        "hi", "lo", "depth", "conv_id", F.coalesce("parent_conv_id", "p_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the rebuilt ``conversations``."""
    nodes = trie(read(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


#: crc32 bit by bit over the decimal digits; sequences are named by the text of their turns' digests.
ORACLE = r"""
WITH src AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS n, conv_id::VARCHAR AS s FROM src GROUP BY 1),
crc AS (
  SELECT conv_id, n, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, flatten(list_transform(range(1, length(s) + 1), lambda i:
      list_transform(range(0, 8), lambda j: ((ascii(s[i]) >> j) & 1)::UBIGINT)))),
    lambda c, b: CASE WHEN (xor(c, b) & 1) = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc FROM ids),
plan AS (SELECT c.conv_id, c.n, (c.crc % 9)::BIGINT AS h, c.conv_id - c.conv_id % 5 AS donor, coalesce(d.n, 0) AS m
         FROM crc c LEFT JOIN ids d ON d.conv_id = c.conv_id - c.conv_id % 5),
rebuilt AS (
  SELECT p.conv_id, s.place + 1 AS depth, s.role, s.text FROM plan p JOIN src s ON s.conv_id = p.donor AND s.place < p.h
  UNION ALL
  SELECT p.conv_id, s.place - p.h + least(p.h, p.m) + 1, s.role, s.text FROM plan p JOIN src s ON s.conv_id = p.conv_id AND s.place >= p.h),
paths AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
members AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
shaped AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1)::BIGINT))
SELECT a.conv_id, a.depth::BIGINT AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
       sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens, a.ends_sha256
FROM shaped a JOIN shaped b ON starts_with(b.path, a.path)
GROUP BY a.path, a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
"""
