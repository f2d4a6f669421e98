"""Operator 11: the prefix trie of conversations from vertical bitmaps.

A node is a distinct sequence of first turns, its members are the conversations
that start with it.

*Cells.*  Turns are numbered per conversation from a global row number (range
partitioning, no task per conversation).  Conversations are cut into shards of
consecutive ids that hold about ``shard_rows`` turns, positions into segments of
``segment``; a cell is one shard's conversations over one segment, so its size
is bounded whatever a conversation or a group of copies holds.

*Bitmaps.*  A cell indexes (position, turn) to a bitset of its conversations.
Depth first, the bitset of a node is intersected with the posting of the next
turn of its least member; what is left of the bitset is the next child's.  One
intersection gives one child, its popcount, its least member and the list of
members that end there.

*Cells together.*  A prefix is known by a 128-bit key: the sum of hashes of its
(position, turn) entries, modulo 2^32 in four lanes.  The sum of the segments
before is a window over one row per conversation and segment, so all cells run
at once.  Nodes of equal key are added up over the shards.  End lists are
chunks in order of ids (at most a shard's conversations each), hashed one after
another as they stream by: the list of a node with very many copies is never
held, though the digest of one list is one task's work by definition.

*Subtrees.*  The nodes whose least member is conversation c are the lower end
of c's path, a branch; a branch hangs on a node of another one.  Totals of
branches are doubled along the pointers between branches (rounds: the logarithm
of the deepest nesting of branches, not of the depth of the trie); sums from a
node down are a running sum along its branch, in blocks of ``block`` depths.

Rows with a null conversation id belong to none and are left out.  A null role
or text is empty.  Turns of equal number are ordered by the MD5 digest of role
and text; repeated rows are turns of their own.  An empty table has no node.
Turns count as equal by their 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import materialise, text_or_empty
from wattlane.llm.embedding_dedup import groups_of
from wattlane.operators.numbering import global_index
from wattlane.session import ship_package

#: White space of ASCII: space, and tab to carriage return.
SPACES = "\t\n\x0b\x0c\r"
_LANES = ["k0", "k1", "k2", "k3"]
_MASK = 0xFFFFFFFF


# ---------------------------------------------------------------------- tables of turns

def number_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos from 1, turn: 16-byte key, words) and conversations (conv, rank, n).

    ``rank`` is the number of turns of all conversations with smaller ids.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.size(F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != ""))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("number"),
                                key.alias("turn"), words.cast("long").alias("words")).where("conv is not null")
    numbered = materialise(global_index(rows, ["conv", "number", "turn"]), "trie-turns")
    convs = materialise(numbered.groupBy("conv").agg(F.min("row_no").alias("rank"), F.count(F.lit(1)).alias("n")), "trie-convs")
    turns = numbered.join(convs.select("conv", "rank"), "conv").select(
        "conv", (F.col("row_no") - F.col("rank") + 1).alias("pos"), "turn", "words")
    return turns, convs


def share_heads(turns: DataFrame, convs: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % group, then c's own turns after its first h.

    h = crc32(decimal c) % most.  Returns tables as ``number_turns``; a rebuilt
    conversation may have no turns (n = 0).
    """
    plan = convs.select("conv", "rank", "n", (F.col("conv") - F.col("conv") % group).alias("base"),
                        (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"))
    bases = convs.select(F.col("conv").alias("bconv"), F.col("n").alias("bn"))
    plan = plan.join(bases, F.col("base") == F.col("bconv"), "left")
    plan = materialise(plan.withColumn("head", F.least("h", F.coalesce("bn", F.lit(0).cast("long"))))
                       .withColumn("tail", F.greatest(F.col("n") - F.col("h"), F.lit(0)))
                       .select("conv", "rank", "base", "h", "head", "tail"), "trie-plan")
    heads = turns.where((F.col("pos") < most) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base").join(
        plan.select("conv", "base", "head"), "base").where("pos <= head").select("conv", "pos", "turn", "words")
    tails = turns.join(plan.select("conv", "h", "head"), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "turn", "words")
    return heads.union(tails), plan.select("conv", "rank", (F.col("head") + F.col("tail")).alias("n"))


# ---------------------------------------------------------------------- one cell

def bitmap_nodes(n: int, ends: np.ndarray, sizes: np.ndarray, turns: np.ndarray, roots: list[int]):
    """Nodes of a cell: yields (first member, depth in the cell, popcount, bitset of the members that end there).

    ``sizes``: turns of each of ``n`` conversations here; ``turns``: their turns
    (whole numbers, equal only for equal turns at equal positions) one after
    another; ``ends``: whether a conversation ends with its last turn here;
    ``roots``: bitsets of conversations that are at one node before the cell.
    """
    at = np.r_[0, np.cumsum(sizes)].tolist()
    size = sizes.tolist()
    codes, where = np.unique(turns, return_inverse=True)
    postings = [0] * len(codes)
    code = where.tolist()
    ending: dict[int, int] = {}
    for i in range(n):
        bit = 1 << i
        for x in code[at[i]:at[i + 1]]:
            postings[x] |= bit
        if ends[i]:
            ending[size[i]] = ending.get(size[i], 0) | bit
    deepest = max(size, default=0)
    longer = [0] * (deepest + 1)            # conversations with more than d turns here
    for i in range(n):
        if size[i]:
            longer[size[i] - 1] |= 1 << i
    for d in range(deepest - 1, -1, -1):
        longer[d] |= longer[d + 1]
    stack = [(r, 0) for r in roots]
    while stack:
        bits, d = stack.pop()
        rest = bits & longer[d]
        while rest:
            first = (rest & -rest).bit_length() - 1
            child = rest & postings[code[at[first] + d]]
            rest ^= child
            yield first, d + 1, child.bit_count(), child & ending.get(d + 1, 0)
            if child & longer[d + 1]:
                stack.append((child, d + 1))


def members(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _cells(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "parent", "depth", "conv", "n", "words", "shard", "ends"]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for g in groups_of(batches, ["shard", "seg"]):
        conv, total = g.column("conv").to_numpy(), g.column("n").to_numpy()
        shard, seg = g.column("shard")[0].as_py(), g.column("seg")[0].as_py()
        sizes = np.array([len(x) for x in g.column("h1")], np.int64)
        h1, h2, words = (_flat(g.column(c)) for c in ("h1", "h2", "words"))
        h1, h2 = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
        came = np.stack([g.column(c).to_numpy().astype(np.uint64) for c in _LANES], axis=1)
        lanes = np.stack([h1 & _MASK, h1 >> 32, h2 & _MASK, h2 >> 32], axis=1).astype(np.uint64).reshape(-1, 4)
        start = np.cumsum(sizes) - sizes
        run = np.cumsum(lanes, axis=0, dtype=np.uint64)
        before = np.r_[np.zeros((1, 4), np.uint64), run][start]        # sums up to each conversation's first turn
        keys = (run - np.repeat(before, sizes, axis=0) + np.repeat(came, sizes, axis=0)).astype(np.uint32)
        local = np.arange(len(h1)) - np.repeat(start, sizes)
        turns = np.empty(len(h1), dtype=[("at", np.int64), ("a", np.uint64), ("b", np.uint64)])
        turns["at"], turns["a"], turns["b"] = local, h1, h2
        inverse = np.unique(turns, return_inverse=True)[1]
        came32 = came.astype(np.uint32)
        bits: dict[bytes, int] = {}
        for i, k in enumerate(came32):
            bits[k.tobytes()] = bits.get(k.tobytes(), 0) | 1 << i
        n = len(conv)
        ends = total == seg * segment + sizes

        def listed(b: int) -> str | None:
            return ",".join(map(str, conv[members(b, n)].tolist())) if b else None

        out: list[tuple] = []
        if seg == 0:
            out.append((bytes(16), None, 0, int(conv[0]), n, 0, shard, listed(sum(1 << i for i in np.flatnonzero(total == 0).tolist()))))
        for first, d, count, last in bitmap_nodes(n, ends & (sizes > 0), sizes, inverse, list(bits.values())):
            k = int(start[first]) + d - 1
            out.append((keys[k].tobytes(), (keys[k - 1] if d > 1 else came32[first]).tobytes(), seg * segment + d, int(conv[first]),
                        count, int(words[k]), shard, listed(last)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


# ---------------------------------------------------------------------- the trie

def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's chunks, comma-joined, in the order of the rows."""
    key, sha, done = None, None, []
    for batch in batches:
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(part.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
            done = []
    if key is not None:
        done.append((key, sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done])], ["key", "ends_sha256"])


def _branch_totals(branches: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(c, saved, leaves) of whole branches with all that hangs on them, by doubling pointers."""
    cur = branches.select("c", "up", "saved", "leaves")
    for i in range(max_rounds):
        hung = cur.where("up is not null")
        if not hung.limit(1).count():
            return cur
        more = hung.groupBy(F.col("up").alias("mc")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("morel"))
        jump = cur.where("up is not null").select(F.col("c").alias("jc"), F.col("up").alias("next"))
        cur = materialise(
            cur.join(jump, F.col("up") == F.col("jc"), "left").join(more, F.col("c") == F.col("mc"), "left").select(
                "c", F.col("next").alias("up"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("morel", F.lit(0))).alias("leaves")), f"trie-doubling-{i}")
    raise RuntimeError("prefix trie: branches nested deeper than 2^64")


def _sum_from(column: str, block: Column) -> Column:
    return F.sum(column).over(Window.partitionBy("owner", block).orderBy(F.desc("depth")))


def prefix_trie(turns: DataFrame, convs: DataFrame, shard_rows: int = 8192, segment: int = 64, block: int = 4096) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node.

    ``turns``: (conv, pos, turn, words), ``convs``: (conv, rank, n) as ``number_turns`` gives them.
    """
    spark = turns.sparkSession
    ship_package(spark)
    shard = F.floor(F.col("rank") / shard_rows).alias("shard")
    seg = F.floor((F.col("pos") - 1) / segment).alias("seg")
    h1, h2 = F.xxhash64("turn", "pos"), F.xxhash64(F.lit("second"), "pos", "turn")
    lanes = [F.col("h1").bitwiseAND(_MASK), F.shiftrightunsigned("h1", 32), F.col("h2").bitwiseAND(_MASK), F.shiftrightunsigned("h2", 32)]
    rows = turns.select("conv", seg, "pos", h1.alias("h1"), h2.alias("h2"), "words")
    parts = rows.groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("t"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(lanes)])
    parts = parts.select("conv", "seg", F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), F.col("t.words").alias("words"),
                         *[f"s{i}" for i in range(4)])
    nothing = [F.array().cast("array<long>").alias(c) for c in ("h1", "h2", "words")]
    parts = parts.union(convs.where("n = 0").select("conv", F.lit(0).cast("long"), *nothing, *[F.lit(0).cast("long")] * 4))
    parts = materialise(parts.join(convs.select(F.col("conv").alias("cc"), "n", shard), F.col("conv") == F.col("cc")).drop("cc"), "trie-parts")
    past = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    kept = [c for c in parts.columns if c not in ("s0", "s1", "s2", "s3")]
    one = parts.where(F.col("n") <= segment).select(*kept, *[F.lit(0).cast("long").alias(k) for k in _LANES])
    sums = parts.where(F.col("n") > segment).select("conv", "seg", *[
        (F.coalesce(F.sum(f"s{i}").over(past), F.lit(0)) % (1 << 32)).alias(k) for i, k in enumerate(_LANES)])
    many = parts.where(F.col("n") > segment).join(sums, ["conv", "seg"]).select(*kept, *_LANES)
    cells = one.union(many).repartition("shard", "seg").sortWithinPartitions("shard", "seg", "conv")
    found = materialise(cells.mapInArrow(
        lambda b: _cells(b, segment), "key binary, parent binary, depth long, conv long, n long, words long, shard long, ends string"), "trie-cells")

    nodes = materialise(found.groupBy("key", "depth").agg(
        F.max("parent").alias("parent"), F.min("conv").alias("owner"), F.sum("n").alias("n_convs"), F.max("words").alias("words")), "trie-nodes")
    ends = found.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = ends.mapInArrow(_digests, "key binary, ends_sha256 string")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("pkey")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("key") == F.col("pkey"), "left").join(ends.withColumnRenamed("key", "ekey"), F.col("key") == F.col("ekey"), "left")
    nodes = materialise(nodes.select(
        "key", "depth", "parent", "owner", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256")), "trie-counted")

    tops = nodes.groupBy("owner").agg(F.min(F.struct("depth", "parent")).alias("head"), F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    on = nodes.select(F.col("key").alias("hkey"), F.col("owner").alias("up"))
    branches = materialise(tops.join(on, F.col("head.parent") == F.col("hkey"), "left").select(
        F.col("owner").alias("c"), F.col("head.depth").alias("depth"), "up", "saved", "leaves"), "trie-branches")
    totals = _branch_totals(branches)
    zero = F.lit(0).cast("long")
    marks = branches.where("up is not null").select("c", "up", "depth").join(totals.select("c", "saved", "leaves"), "c").select(
        F.explode(F.array(
            F.struct(F.col("up").alias("mowner"), (F.col("depth") - 1).alias("mdepth"), F.col("saved").alias("hung"), F.col("leaves").alias("hungl"),
                     F.lit(None).cast("long").alias("up")),
            F.struct(F.col("c").alias("mowner"), F.col("depth").alias("mdepth"), zero.alias("hung"), zero.alias("hungl"), F.col("up").alias("up")))).alias("m"))
    marks = marks.groupBy("m.mowner", "m.mdepth").agg(F.sum("m.hung").alias("hung"), F.sum("m.hungl").alias("hungl"), F.max("m.up").alias("up"))
    laid = materialise(nodes.join(marks, (F.col("owner") == F.col("mowner")) & (F.col("depth") == F.col("mdepth")), "left").select(
        "owner", "depth", F.when(F.col("depth") > 0, F.coalesce("up", "owner")).alias("parent_conv_id"), "n_convs", "n_children", "ends_sha256",
        (F.col("own") + F.coalesce("hung", zero)).alias("v"), (F.col("leaf") + F.coalesce("hungl", zero)).alias("vl"),
        F.floor(F.col("depth") / block).alias("blk")), "trie-laid")
    deeper = Window.partitionBy("owner").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.groupBy("owner", "blk").agg(F.sum("v").alias("bv"), F.sum("vl").alias("bl")).select(
        "owner", "blk", F.sum("bv").over(deeper).alias("ov"), F.sum("bl").over(deeper).alias("ol")).where("ov is not null")
    inner = laid.withColumns({"rv": _sum_from("v", F.col("blk")), "rl": _sum_from("vl", F.col("blk"))})
    return inner.join(offsets, ["owner", "blk"], "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("rl") + F.coalesce("ol", zero)).alias("n_leaves"), (F.col("rv") + F.coalesce("ov", zero)).alias("saved_tokens"), "ends_sha256")
