"""A trie of all conversations by their beginnings, built by bursting.

A turn counts by two 64-bit hashes of its place, role and text, and a beginning by the exclusive or of its turns'
hashes (128 bits), so the beginning of any length is known without the turns before it. Texts are read once and never
shuffled again after their turns are numbered.

1. Conversations are cut into stretches of at most ``stretch`` turns. A stretch hangs under a head, the beginning before
   it. Equal stretches of one head are one row with a count, so a conversation that a third of all have is one row.
2. The rows of one head are its container. Containers of more than ``room`` rows burst: the head becomes a node of the
   trie's top, and every row steps down to the head that its next turn makes. This repeats until no container is too
   large. One common first turn, or ten, only mean some more rounds.
3. The containers that remain are dealt out by head; a task sorts the rows of a container by their turns and sweeps over
   them with a stack, which gives all nodes below the head with their members, children, leaves and savings.
4. What lies below a head is added to the heads that burst above it, round by round, and the stretches that continue
   others (the deepest come first) hand their sums to the node they continue.

A conversation of n turns takes n / ``stretch`` passes of steps 2 to 4; those shorter than ``stretch`` take one. No
task holds more than a container, ``room`` rows of ``stretch`` turns. A conversation that holds a third of all turns is
numbered over many tasks (ranges of turns), as are the members that end at one node.

Turns of one number are taken in the order of role and text; repeated rows are turns of their own; null roles and texts
are empty; rows without a conv_id belong to no conversation. An empty table has no trie, not even a root.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.snapshots import cut
from .common import on_workers

#: Turns of a row at most, and rows of a container that isn't burst.
STRETCH, ROOM = 256, 1000
#: Up to so many burst heads are broadcast (some 100 bytes each).
_BROADCAST = 50_000
#: Blocks in which turns of one conversation look up what belongs to all of them.
_BLOCK = 4096
_NODE = "one bigint, two bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
_SWEPT = _NODE + ", is_node boolean, is_head boolean, up_one bigint, up_two bigint"


# Conversations


def _placed(batches):
    """Rows in order of conversation and turn, with their place among those of it that this task has."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(conv):
            continue
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = last is None or conv[0] != last
        at = np.arange(len(conv))
        begin = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(begin < 0, at + seen, at - begin)
        last, seen = conv[-1], int(place[-1]) + 1
        columns = [batch.column(0), pa.array(np.full(len(conv), part), pa.int32()), pa.array(place, pa.int64()), *(batch.column(k) for k in (1, 2, 3))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "part", "place", "one", "two", "size"])


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, place (from 0), hashes of role and text (one, two) and the text's bytes (size) of every turn."""
    on_workers(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv"), "turn", role.alias("role"), text.alias("body"))
    dealt = turns.repartitionByRange("conv", "turn").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "body")
    hashed = dealt.select(
        "conv", F.xxhash64("role", "body").alias("one"), F.xxhash64("role", "body", F.lit(1)).alias("two"), F.octet_length("body").cast("bigint").alias("size")
    )
    local = cut(hashed.mapInArrow(_placed, "conv bigint, part int, place bigint, one bigint, two bigint, size bigint"), "turns")
    # A task goes on with one conversation of an earlier one at most: as many rows as tasks.
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = local.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0").drop("n")
    both = local.join(F.broadcast(shares), ["conv", "part"], "left")
    return both.select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "one", "two", "size")


def grafted(turns: DataFrame, most: int = 9, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: turns as they were, and (conv, length) of every conversation.

    The first h turns of c are those of c - c % ``every`` (all if it has fewer), h being crc32 of c's digits modulo
    ``most``; its own turns follow from the (h + 1)-th on.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % every})
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    beginnings = turns.where(F.col("place") < most - 1).withColumnRenamed("conv", "base")
    given = convs.where("given > 0").select("conv", "base", "given").join(beginnings, "base").where("place < given")
    # The turns of a long conversation look its row up in blocks, each a key of its own.
    rows = convs.where("n > h").select("conv", "h", "given", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {_BLOCK}"))).alias("block"))
    own = turns.withColumn("block", F.expr(f"place div {_BLOCK}")).join(rows, ["conv", "block"]).where("place >= h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("given"))
    columns = ["conv", "place", "one", "two", "size"]
    return given.select(columns).unionByName(own.select(columns)), convs.select("conv", "length")


# The trie


def _stretches(turns: DataFrame, convs: DataFrame, stretch: int) -> tuple[DataFrame, DataFrame]:
    """Distinct stretches under their heads with counts; and the node at which every conversation ends."""
    mark = [F.xxhash64("place", "one", "two"), F.xxhash64("place", "one", "two", F.lit(1))]
    marked = turns.select("conv", "place", "size", mark[0].alias("one"), mark[1].alias("two"))
    turn = F.struct("place", "one", "two", "size")
    full = marked.groupBy("conv", F.expr(f"place div {stretch}").alias("k")).agg(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t.one.alias("one"), t.two.alias("two"), t.size.alias("size"))).alias("turns"),
        F.bit_xor("one").alias("x"), F.bit_xor("two").alias("y"),
    )
    nothing = F.array().cast(full.schema["turns"].dataType)
    zero = F.lit(0).cast("bigint")
    ended = convs.where(F.col("length") % stretch == 0).select("conv", F.expr(f"length div {stretch}").alias("k"), nothing.alias("turns"), zero.alias("x"), zero.alias("y"))
    parts = cut(full.unionByName(ended), "stretches")
    # Only conversations of several stretches have heads other than the root.
    several = parts.where("k > 0").select("conv").distinct()
    sums = parts.select("conv", "k", "x", "y").join(several, "conv")
    earlier = Window.partitionBy("conv").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("conv", "k", F.bit_xor("x").over(earlier).alias("one"), F.bit_xor("y").over(earlier).alias("two")).where("k > 0")
    placed = parts.join(heads, ["conv", "k"], "left").withColumns({c: F.coalesce(c, zero) for c in ("one", "two")})
    rows = placed.groupBy("k", "one", "two", "x", "y").agg(F.any_value("turns").alias("turns"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    ends = parts.groupBy("conv").agg(F.bit_xor("x").alias("one"), F.bit_xor("y").alias("two"))
    return cut(rows, "rows"), ends


def _sweep(rows: list[tuple], nodes: dict[str, list]) -> None:
    """All nodes of one container. rows: (key of the turns, turns as (one, two, size), n, conv, below), rest alike."""
    rows.sort(key=lambda r: r[0])
    head = rows[0][5]
    one, two, depth = [head["one"]], [head["two"]], [head["depth"]]
    size, up, n, conv = [head["size"]], [-1], [0], [None]
    children, leaves, saved = [0], [0], [0]
    stack, path = [0], []

    def close():
        x = stack.pop()
        if not children[x]:
            leaves[x] = 1
        saved[x] += (n[x] - 1) * size[x]
        if stack:
            y = stack[-1]
            n[y] += n[x]
            conv[y] = conv[x] if conv[y] is None else min(conv[x], conv[y])
            children[y] += 1
            leaves[y] += leaves[x]
            saved[y] += saved[x]

    for _, turns, times, least, below, _ in rows:
        same = 0
        while same < len(path) and same < len(turns) and path[same][:2] == turns[same][:2]:
            same += 1
        while len(stack) > same + 1:
            close()
        for a, b, c in turns[same:]:
            y = stack[-1]
            stack.append(len(one))
            one.append(one[y] ^ a)
            two.append(two[y] ^ b)
            depth.append(depth[y] + 1)
            size.append(c)
            up.append(y)
            n.append(0)
            conv.append(None)
            children.append(0)
            leaves.append(0)
            saved.append(0)
        path, x = turns, stack[-1]
        n[x] += times
        conv[x] = least if conv[x] is None else min(least, conv[x])
        if below is not None:
            children[x], leaves[x], saved[x] = children[x] + below[0], leaves[x] + below[1], saved[x] + below[2]
    while stack:
        close()
    if head["inner"] and not children[0]:  # the node that is continued counts itself
        leaves[0] = 0
    k = len(one)
    parents = [head["up_conv"], *(conv[y] for y in up[1:])]
    for name, values in (("one", one), ("two", two), ("conv_id", conv), ("depth", depth), ("parent_conv_id", parents), ("n_convs", n), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
        nodes[name] += values
    nodes["is_node"] += [not head["inner"], *[True] * (k - 1)]
    nodes["is_head"] += [True, *[False] * (k - 1)]
    nodes["up_one"] += [head["up_one"], *[None] * (k - 1)]
    nodes["up_two"] += [head["up_two"], *[None] * (k - 1)]


_FIELDS = {f.split()[0]: f.split()[1] for f in _SWEPT.split(", ")}
_ARROW = pa.schema([(name, pa.bool_() if kind == "boolean" else pa.int64()) for name, kind in _FIELDS.items()])


def _swept(batches):
    """Rows in order of their heads to nodes."""
    nodes: dict[str, list] = {name: [] for name in _FIELDS}
    held: list[tuple] = []
    last = None
    for batch in batches:
        columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
        turns = columns.pop("turns")
        flat, bounds = turns.flatten(), np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
        one, two, size = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("one", "two", "size"))
        data = np.ascontiguousarray(np.column_stack([one, two])).tobytes()
        one, two, size = one.tolist(), two.tolist(), size.tolist()
        heads = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).to_pylist()
        for i, h in enumerate(heads):
            a, b = bounds[i] + h["at"], bounds[i + 1]
            if held and (h["one"], h["two"]) != last:
                _sweep(held, nodes)
                held = []
                if len(nodes["one"]) > 50_000:
                    yield pa.RecordBatch.from_pydict(nodes, _ARROW)
                    nodes = {name: [] for name in _FIELDS}
            last = h["one"], h["two"]
            below = None if h["below_children"] is None else (h["below_children"], h["below_leaves"], h["below_saved"])
            held.append((data[16 * a : 16 * b], list(zip(one[a:b], two[a:b], size[a:b])), h["n"], h["conv"], below, h))
    if held:
        _sweep(held, nodes)
    yield pa.RecordBatch.from_pydict(nodes, _ARROW)


_HEAD = ["one", "two", "depth", "size", "inner", "up_one", "up_two", "up_conv"]


def _burst(rows: DataFrame, room: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Containers of at most ``room`` rows, and the heads above them, a frame for each round."""
    small, tops = [], []
    while True:
        big = rows.groupBy(*_HEAD).agg(F.count("*").alias("rows"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id")).where(F.col("rows") > room)
        big = cut(big.drop("rows"), "heads")
        many = big.count()
        if not many:
            return [*small, rows], tops
        tops.append(big)
        known = big.select("one", "two", F.col("conv_id").alias("top_conv"))
        known = F.broadcast(known) if many <= _BROADCAST else known
        small.append(rows.join(known, ["one", "two"], "left_anti"))
        turn = F.col("turns")[F.col("at")]
        below = rows.join(known, ["one", "two"]).where(F.col("at") < F.size("turns"))  # those that end here have been counted
        rows = cut(below.select(
            F.col("one").bitwiseXOR(turn.one).alias("one"), F.col("two").bitwiseXOR(turn.two).alias("two"),
            (F.col("depth") + 1).alias("depth"), turn.size.alias("size"), F.lit(False).alias("inner"),
            F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("top_conv").alias("up_conv"),
            (F.col("at") + 1).alias("at"), "turns", "n", "conv", "below_children", "below_leaves", "below_saved",
        ), "burst")


def _topped(tops: list[DataFrame], swept: DataFrame) -> list[DataFrame]:
    """The nodes that burst, from the last round up, each with the sums of the heads below it."""
    above, out = swept.where("is_head and up_one is not null").select("up_one", "up_two", "n_leaves", "saved_tokens"), []
    for top in reversed(tops):
        sums = above.groupBy(F.col("up_one").alias("one"), F.col("up_two").alias("two")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")
        )
        own = (F.col("n_convs") - 1) * F.col("size")
        full = top.join(sums, ["one", "two"]).withColumns({"saved_tokens": F.col("below") + own, "is_node": ~F.col("inner"), "is_head": F.lit(True)})
        full = cut(full.withColumnsRenamed({"up_conv": "parent_conv_id"}).select(*_FIELDS), "tops")
        out.append(full)
        above = above.unionByName(full.where("up_one is not null").select(above.columns))
    return out


def _digests(ends: DataFrame) -> DataFrame:
    """one, two, ends_sha256 of every node at which a conversation ends.

    Members are joined in pieces of a bounded length over ranges of (node, id), however many end at one node; the
    pieces then run through its hash in order.
    """

    def joined(batches):
        node, ids = None, []

        def piece():
            return pa.RecordBatch.from_pydict({"one": [node[0]], "two": [node[1]], "first": [ids[0]], "piece": [",".join(map(str, ids))]}, schema)

        schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (node != (a, b) or len(ids) >= 4096):
                    yield piece()
                    ids = []
                node = a, b
                ids.append(c)
        if ids:
            yield piece()

    def digested(batches):
        node, sha = None, None
        schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("ends_sha256", pa.string())])
        done: dict[str, list] = {"one": [], "two": [], "ends_sha256": []}

        def close():
            for name, value in zip(done, (*node, sha.hexdigest())):
                done[name].append(value)

        for batch in batches:
            for a, b, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if node == (a, b):
                    sha.update(b"," + text.encode())
                else:
                    if node:
                        close()
                    node, sha = (a, b), hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_pydict(done, schema)
            done = {name: [] for name in done}
        if node:
            close()
        yield pa.RecordBatch.from_pydict(done, schema)

    sorted_ends = ends.select("one", "two", "conv").repartitionByRange("one", "two", "conv").sortWithinPartitions("one", "two", "conv")
    pieces = sorted_ends.mapInArrow(joined, "one bigint, two bigint, first bigint, piece string")
    pieces = pieces.repartition("one", "two").sortWithinPartitions("one", "two", "first").select("one", "two", "piece")
    return pieces.mapInArrow(digested, "one bigint, two bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, stretch: int = STRETCH, room: int = ROOM) -> DataFrame:
    """The nodes of all conversations.

    ``turns``: conv, place (from 0, gapless), one and two (hashes of what makes a turn equal to another), size;
    ``convs``: conv and length, those without turns included. A row for each distinct beginning: one and two (its hash),
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (of all nodes from
    it down, members beyond the first times the last turn's size) and ends_sha256 (of the members that end here).
    """
    spark = on_workers(turns.sparkSession)
    rows, ends = _stretches(turns, convs, stretch)
    last = rows.agg(F.max("k")).first()[0]
    nodes, below = [spark.createDataFrame([], _NODE)], None
    for k in range(-1 if last is None else last, -1, -1):
        end = [F.col("one").bitwiseXOR(F.col("x")), F.col("two").bitwiseXOR(F.col("y"))]
        of_k = rows.where(F.col("k") == k).withColumns({"end_one": end[0], "end_two": end[1]})
        if below is None:
            of_k = of_k.withColumns({f"below_{c}": F.lit(None).cast("bigint") for c in ("children", "leaves", "saved")})
        else:
            full = F.size("turns") == stretch
            of_k = of_k.join(below, full & (F.col("end_one") == F.col("head_one")) & (F.col("end_two") == F.col("head_two")), "left")
        none = F.lit(None).cast("bigint")
        held = of_k.select(
            "one", "two", F.lit(k * stretch).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("size"), F.lit(k > 0).alias("inner"),
            none.alias("up_one"), none.alias("up_two"), none.alias("up_conv"), F.lit(0).alias("at"),
            "turns", "n", "conv", "below_children", "below_leaves", "below_saved",
        )
        small, tops = _burst(held, room)
        dealt = reduce(DataFrame.unionByName, small).repartition("one", "two").sortWithinPartitions("one", "two")
        swept = cut(dealt.mapInArrow(_swept, _SWEPT), "swept")
        found = reduce(DataFrame.unionByName, _topped(tops, swept), swept)
        nodes.append(found.where("is_node").select(*nodes[0].columns))
        below = found.where("is_head and not is_node").select(
            F.col("one").alias("head_one"), F.col("two").alias("head_two"),
            F.col("n_children").alias("below_children"), F.col("n_leaves").alias("below_leaves"), F.col("saved_tokens").alias("below_saved"),
        )
    every = reduce(DataFrame.unionByName, nodes).join(_digests(ends), ["one", "two"], "left")
    return every.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
