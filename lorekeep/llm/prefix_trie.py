"""Prefix trie of conversations by van Emde Boas recursion: cut at half depth, name the cut prefixes, graft totals upward.

A sequence of turns is cut at half of the depth. The prefix up to the cut gets a name, the first halves form the upper
trie, and the second halves, each below the name of its cut prefix, form the lower forests. All parts are cut again at
their own half, together, until a part is one turn. So a prefix of d turns is named by the cut prefix that is the lowest
set bit of d shorter, and by the turns between. Names are 128-bit hashes of what they stand for: equal prefixes get equal
names wherever they are named, and no name has to be handed around.

Cuts of at most ``CHUNK`` turns are made inside one row (a stretch of one conversation, aligned, so its size is bounded
however long a conversation is); cuts above that are the same recursion on a table with one row per stretch. Totals go
back up the cuts from the innermost: a cut node sends its total to the nodes of its upper part above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import stored
from lorekeep.scale import BROADCAST_BYTES, ranged_sum

#: Turns of one conversation in one row; a power of two.
CHUNK = 64
ROOT = hashlib.md5(b"root").digest()
PIECE_BYTES = 1 << 20


def paired(left: bytes, right: bytes) -> bytes:
    return hashlib.md5(left + right).digest()


def block_hash(steps: list[bytes], low: int, size: int, known: dict) -> bytes:
    """Hash of an aligned run of steps, from its halves."""
    if size == 1:
        return steps[low]
    if (low, size) not in known:
        half = size // 2
        known[low, size] = paired(block_hash(steps, low, half, known), block_hash(steps, low + half, half, known))
    return known[low, size]


def names_below(root: bytes, steps: list[bytes], known: dict) -> list[bytes]:
    """Names of the prefixes of 0, 1, ... steps (at most CHUNK - 1) below ``root``."""
    names = [root]
    for d in range(1, min(len(steps), CHUNK - 1) + 1):
        cut = d & -d
        names.append(paired(names[d - cut], block_hash(steps, d - cut, cut, known)))
    return names


def name_prefixes(steps: DataFrame, depth: int) -> list[DataFrame]:
    """Name every prefix of every sequence. ``steps``: conv, k (from 0, without gaps), h; ``depth``: the longest.

    Returns one table per level of cuts, the finest first: conv, d, name, parent, above (the names of the upper part that
    the prefix is cut from, down to its parent). Depths of level i count stretches of CHUNK ** i turns.
    """
    stretch = steps.groupBy("conv", F.expr(f"k div {CHUNK}").alias("j")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("steps"))
    stretch = stretch.select("conv", "j", F.col("steps.h").alias("steps"))
    coarser: list[DataFrame] = []
    if depth >= CHUNK:
        stretch = stored(stretch, "stretches")
        coarser = name_prefixes(whole_hashes(stretch), depth // CHUNK)
        # a full stretch needs the names at both of its ends, the last one only that of its beginning
        full = F.size("steps") == CHUNK
        ends = coarser[0].select(F.col("conv").alias("_c"), F.col("d").alias("_d"), F.col("name").alias("_name"), F.col("parent").alias("_parent"))
        met = stretch.join(ends, (F.col("conv") == F.col("_c")) & (F.col("j") + full.cast("int") == F.col("_d")), "left")
        stretch = met.select("conv", "j", "steps", F.when(full, F.col("_parent")).otherwise(F.col("_name")).alias("root"), F.when(full, F.col("_name")).alias("end"))
    else:
        stretch = stretch.select("conv", "j", "steps", F.lit(None).cast("binary").alias("root"), F.lit(None).cast("binary").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, j, hashes, root, end in zip(*(c.to_pylist() for c in batch.columns)):
                names = names_below(root or ROOT, hashes, {})
                for d in range(1, len(names)):
                    out.append((conv, j * CHUNK + d, names[d], names[d - 1], names[d - (d & -d) : d]))
                if len(hashes) == CHUNK:
                    out.append((conv, j * CHUNK + CHUNK, end, names[-1], names[1:]))
                if len(out) >= 20_000:
                    yield as_batch(out)
                    out = []
            if out:
                yield as_batch(out)

    return [stored(stretch.mapInArrow(run, NAMED), "prefixes"), *coarser]


NAMED = "conv long, d long, name binary, parent binary, above array<binary>"
NAMED_ARROW = pa.schema([("conv", pa.int64()), ("d", pa.int64()), ("name", pa.binary()), ("parent", pa.binary()), ("above", pa.list_(pa.binary()))])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), NAMED_ARROW)], schema=NAMED_ARROW)


def whole_hashes(stretches: DataFrame) -> DataFrame:
    """conv, k (number of the stretch), h of every full stretch: the steps of the next level of cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [block_hash(steps, 0, CHUNK, {}) for steps in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hashes, pa.binary())], names=["conv", "k", "h"])

    return stretches.filter(F.size("steps") == CHUNK).select("conv", "j", "steps").mapInArrow(run, "conv long, k long, h binary")


def graft(levels: list[DataFrame], totals: DataFrame, depth: int, unit: int = 1) -> DataFrame:
    """Totals of whole subtrees from those of single nodes. ``totals``: name, d, leaves, saved; nodes of ``levels[0]`` and the root.

    Parts of 2, 4, ... steps are put together in turn: the nodes at which the lower half begins send their totals to the
    nodes of the upper half above them. The tops of whole stretches are then a trie of their own, whose totals are grafted
    first and then sent on inside each stretch.
    """
    nodes = levels[0]
    at = F.expr(f"d % {CHUNK}")
    half = 1
    while half < CHUNK and half <= depth:
        cut = nodes.filter((at != 0) & (at.bitwiseAND(-at) == half))
        totals = stored(added(totals, cut, totals, unit), "totals")
        half *= 2
    if len(levels) > 1:
        tops = F.expr(f"d % {CHUNK * unit}") == 0
        whole = graft(levels[1:], totals.filter(tops), depth // CHUNK, unit * CHUNK)
        totals = stored(added(totals.filter(~tops).unionByName(whole), nodes.filter(at == 0), whole, unit), "totals")
    return totals


def added(totals: DataFrame, cut: DataFrame, of: DataFrame, unit: int) -> DataFrame:
    """``totals`` and what the nodes of ``cut`` send to those above them, which is their total in ``of``."""
    sent = cut.select("name", "above", F.col("d").alias("depth")).join(of.select("name", "leaves", "saved"), "name")
    sent = sent.select("depth", F.size("above").alias("n"), "leaves", "saved", F.posexplode("above").alias("i", "name"))
    to = sent.select("name", ((F.col("depth") - F.col("n") + F.col("i")) * unit).alias("d"), "leaves", "saved")
    return totals.unionByName(to).groupBy("name", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def hash_lists(members: DataFrame) -> DataFrame:
    """SHA-256 of the decimal ids of each name, ascending, joined by commas. ``members``: name, conv.

    Ids are written out over ranges of (name, id) of equal row counts, so one name with a third of all ids is many
    ranges; the task of a name then reads pieces of text in order and holds none of them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            out = []
            for name, ids in groupby(rows, lambda r: r[0]):
                held = [i for _, i in ids]
                for a in range(0, len(held), PIECE_BYTES // 20):
                    part = held[a : a + PIECE_BYTES // 20]
                    out.append((name, part[0], ",".join(map(str, part)).encode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], names=["name", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name == last:
                    state.update(b"," + ids)
                else:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = name, hashlib.sha256(ids)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["name", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    pieces = members.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(write, "name binary, first long, ids binary")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digest, "name binary, ends_sha256 string")


def prefix_trie(members: DataFrame, steps: DataFrame) -> DataFrame:
    """The trie of sequences: one row per distinct prefix.

    ``members``: conv (long), each once, sequences without steps too. ``steps``: conv, k (from 0, without gaps), h (binary,
    equal for equal steps), weight. Per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens ((n_convs - 1) times the weight of
    its last step, over its subtree), ends_sha256 (of the ids of the sequences that end there). No members give no rows.
    """
    depth = steps.agg(F.coalesce(F.max("k") + 1, F.lit(0))).first()[0]
    levels = name_prefixes(steps, depth)
    prefixes = levels[0]
    root = F.lit(bytearray(ROOT))
    weighted = prefixes.select("conv", "d", "name", "parent").join(steps.select("conv", (F.col("k") + 1).alias("d"), "weight"), ["conv", "d"])
    rooted = members.select("conv", F.lit(0).cast("long").alias("d"), root.alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("weight"))
    every = weighted.unionByName(rooted)
    # the members of a node have all else in common, so any one's does
    nodes = stored(
        every.groupBy("name", "d").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("weight").alias("weight"), F.first("parent").alias("parent")), "nodes"
    )
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    counted = stored(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    own = counted.select("name", "d", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("weight")).alias("saved"))
    cuts = [stored(level.groupBy("name", "d").agg(F.first("above").alias("above")), "cuts") for level in levels]
    totals = graft(cuts, own, depth)
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    last = F.max(F.struct("d", "name")).alias("last")
    ends = hash_lists(every.groupBy("conv").agg(last).select(F.col("last.name").alias("name"), "conv"))
    done = counted.join(totals.select("name", "leaves", "saved"), "name").join(ends, "name", "left").join(parents, "parent", "left")
    return done.select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv, k (from 0), h, weight (code points of the text) of (conv_id, turn, role, text), null turns first.

    Null role and text are empty; equal turns follow in order of role and text; rows without a conv_id are left out;
    repeated rows are turns of their own. A conversation with a third of all turns spreads over many tasks.
    """
    full = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    step = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    hashed = full.withColumn("h", step).withColumn("weight", F.length("text").cast("long"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    placed = ranged_sum(hashed, ["conv"], order, F.lit(1), "at", keep=["conv", "h", "weight"])
    return placed.select("conv", (F.col("at") - 1).alias("k"), "h", "weight")


def rebuilt(ordered: DataFrame, heads: int = 6, block: int = 100) -> tuple[DataFrame, DataFrame]:
    """(members, steps): each conversation c begins with the first h turns of conversation c - c % block, then goes on with
    its own turns after its first h, where h is the unsigned crc32 of c in decimal modulo ``heads``.

    The remainder has the sign of c. A block without its first conversation lends no turns.
    """
    members = stored(ordered.select("conv").distinct(), "members")
    lent = F.crc32(F.col("conv").cast("string")) % heads
    base = F.col("conv") - F.expr(f"conv % {block}")
    lenders = ordered.filter(f"conv % {block} = 0 AND k < {heads - 1}").select(F.col("conv").alias("b"), F.col("k").alias("bk"), "h", "weight")
    first = stored(lenders, "lenders")
    borrowed = members.select("conv", base.alias("b"), lent.alias("n")).join(first, "b").filter("bk < n").select("conv", F.col("bk").alias("k"), "h", "weight")
    sizes = first.groupBy(F.col("b").alias("b")).agg(F.count("*").alias("size"))
    few = sizes.count() * 32 <= BROADCAST_BYTES
    own = ordered.withColumn("n", lent).withColumn("b", base).filter("k >= n").join(F.broadcast(sizes) if few else sizes, "b", "left")
    moved = own.select("conv", (F.col("k") - F.col("n") + F.least("n", F.coalesce("size", F.lit(0)))).alias("k"), "h", "weight")
    return members, stored(borrowed.unionByName(moved), "rebuilt")
