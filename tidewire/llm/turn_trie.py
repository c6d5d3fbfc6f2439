"""Prefix trie of conversations by an LCP-aware external mergesort.

1. A turn becomes a 128-bit digest of role and text and its number of code points; texts aren't shuffled.  A
   conversation is the sequence of its turns' digests, in the order of `turn` (null first, ties by digest).
2. Equal sequences become one row: their conversations, ranged by sequence and id over all tasks, are packed into
   lists of at most 8,192 ids, and the packs of one sequence are hashed in order as a stream, so that a task holds one
   pack at a time however many conversations are alike.
3. Distinct sequences are ranged over tasks (Spark's shuffle is the outer storage of the sort; a task's share is
   bounded by `share`).  A task sorts each Arrow batch into a run that carries, with each sequence, the number of turns
   shared with the one before (LCP).  A loser tree merges the runs: of two heads the one with the larger LCP to the last
   output is smaller, and only heads with equal LCPs compare turns, from the LCP on.  No shared turn is compared twice.
4. The merged stream keeps a stack of open nodes.  A sequence that shares d turns with the one before finishes the
   nodes deeper than d, adds their figures to their parents, and opens its own.
5. Only the nodes on the path of a task's first or last sequence can have members in other tasks.  They are written as
   two rows for each task; one more pass over these rows, in order, with the same stack finishes them.  These rows
   grow with the number of tasks, not of conversations.

Two turns, or two sequences, count as equal if their digests are (128 bits).

Cases: null roles and texts are empty; rows with a null conversation id belong to none and are left out; turns are
taken in the order of the numbers given, repeated rows too (each is a turn); a conversation without turns is a member of the root alone;
texts are hashed whole; a conversation is one row of 20 bytes a turn; other columns, whatever their names, are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forget, keep, parts, ship

UNIT, PACK = 16, 8_192
NONE = hashlib.sha256(b"").hexdigest()


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """_c, _turns: for each conversation its turns in order as (turn, d: digest, n: code points of the text)."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * UNIT)
    one = F.struct(F.col(turn_col).alias("turn"), digest.alias("d"), F.length(text).alias("n"))
    narrow = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("_c"), one.alias("_one"))
    return narrow.groupBy("_c").agg(F.sort_array(F.collect_list("_one")).alias("_turns"))


def with_shared_head(lists: DataFrame, head: Column, share: Column) -> DataFrame:
    """The first `share` turns of conversation `head` (fewer or none if it has no more), then a conversation's own turns after its first `share`."""
    lists = keep(lists, "turns")
    of_head = lists.select(F.col("_c").alias("_h"), F.col("_turns").alias("_first"))
    own = lists.select("_c", "_turns", head.alias("_h"), share.cast("int").alias("_n"))
    first = F.coalesce(F.slice("_first", 1, F.col("_n")), F.slice("_turns", 1, 0))
    return own.join(of_head, "_h", "left").select("_c", F.concat(first, F.slice("_turns", F.col("_n") + 1, F.greatest(F.size("_turns"), F.lit(1)))).alias("_turns"))


def _keys(lists: DataFrame) -> DataFrame:
    """_c, _key (the digests behind one another), _lens (code points of the texts)."""
    return lists.select("_c", F.unhex(F.array_join(F.transform("_turns", lambda t: t["d"]), "")).alias("_key"), F.transform("_turns", lambda t: t["n"].cast("bigint")).alias("_lens"))


def _packs(keyed: DataFrame) -> DataFrame:
    """_key, _lens, _first, _n, _pack: ids of equal sequences, ascending, at most PACK of them, joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lens, ids, out = None, None, [], []

        def packed() -> tuple:
            return key, lens, ids[0], len(ids), ",".join(map(str, ids))

        for batch in batches:
            for k, n, c in zip(batch["_key"].to_pylist(), batch["_lens"].to_pylist(), batch["_c"].to_pylist(), strict=True):
                if ids and (k != key or len(ids) == PACK):
                    out.append(packed())
                    ids = []
                key, lens = k, n
                ids.append(c)
            if out:
                yield _batch(out, PACKS)
                out = []
        if ids:
            yield _batch([packed()], PACKS)

    ranged = keyed.repartitionByRange(parts(keyed.sparkSession), "_key", "_c").sortWithinPartitions("_key", "_c")
    return ranged.mapInArrow(run, "_key binary, _lens array<bigint>, _first bigint, _n bigint, _pack string")


PACKS = pa.schema([("_key", pa.binary()), ("_lens", pa.list_(pa.int64())), ("_first", pa.int64()), ("_n", pa.int64()), ("_pack", pa.string())])
DISTINCT = pa.schema([("_key", pa.binary()), ("_lens", pa.list_(pa.int64())), ("_least", pa.int64()), ("_n", pa.int64()), ("_ends", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def distinct_sequences(packs: DataFrame) -> DataFrame:
    """_key, _lens, _least (smallest id), _n, _ends (SHA-256 of the ids, ascending, joined by commas) of each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, n, digest = None, None, 0, hashlib.sha256()

        def done() -> tuple:
            return key, head[0], head[1], n, digest.hexdigest()

        for batch in batches:
            out = []
            for k, lens, first, size, pack in zip(*(batch[c].to_pylist() for c in PACKS.names), strict=True):
                if k != key:
                    if n:
                        out.append(done())
                    key, head, n, digest = k, (lens, first), 0, hashlib.sha256()
                digest.update((("," if n else "") + pack).encode())
                n += size
            if out:
                yield _batch(out, DISTINCT)
        if n:
            yield _batch([done()], DISTINCT)

    return packs.repartition(parts(packs.sparkSession), "_key").sortWithinPartitions("_key", "_first").mapInArrow(run, "_key binary, _lens array<bigint>, _least bigint, _n bigint, _ends string")


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of turns that two sequences share at their beginning; the first `known` are known to be shared."""
    most = min(len(a), len(b)) // UNIT
    while known < most and a[known * UNIT:(known + 1) * UNIT] == b[known * UNIT:(known + 1) * UNIT]:
        known += 1
    return known


def sorted_run(rows: list[tuple]) -> list[tuple[int, tuple]]:
    """(turns shared with the row before, row) in the order of the rows' first column."""
    rows.sort(key=lambda r: r[0])
    return [(shared(rows[i - 1][0], r[0]) if i else 0, r) for i, r in enumerate(rows)]


def merged(runs: list[list[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """One sorted stream of sorted runs, with the turns shared with the row before, by a loser tree."""
    runs = [r for r in runs if r]
    width = 1 << max(0, len(runs) - 1).bit_length()
    streams = [iter(r) for r in runs] + [iter(())] * (width - len(runs))
    head = [next(s, None) for s in streams]
    lcp = [0] * width  # of a head with the last output
    loser = [-1] * width

    def first_is_less(i: int, j: int) -> bool:
        """Whether head i goes before head j; the later one then knows what it shares with the earlier one."""
        if head[i] is None or head[j] is None:
            return head[j] is None
        if lcp[i] != lcp[j]:
            return lcp[i] > lcp[j]
        a, b = head[i][1][0], head[j][1][0]
        k = shared(a, b, lcp[i])
        less = a[k * UNIT:(k + 1) * UNIT] <= b[k * UNIT:(k + 1) * UNIT]
        lcp[j if less else i] = k
        return less

    def play(at: int, stream: int) -> int:
        """The winner of a match of the stream with the loser kept at a node; the node keeps the other."""
        other = loser[at]
        if first_is_less(stream, other):
            return stream
        loser[at] = stream
        return other

    def build(at: int) -> int:
        if at >= width:
            return at - width
        a, b = build(2 * at), build(2 * at + 1)
        win, loser[at] = (a, b) if first_is_less(a, b) else (b, a)
        return win

    if not runs:
        return
    win = build(1)
    while head[win] is not None:
        yield lcp[win], head[win][1]
        head[win] = next(streams[win], None)
        lcp[win] = head[win][0] if head[win] else 0
        at, now = (win + width) // 2, win
        while at:
            now = play(at, now)
            at //= 2
        win = now


class Node:
    """An open node; of its finished children only sums are kept, and their rows until its own smallest member is known."""

    __slots__ = ("depth", "size", "digest", "least", "n", "children", "leaves", "saved", "ends", "edge", "waiting")

    def __init__(self, depth: int, size: int, digest: bytes, edge: bool) -> None:
        self.depth, self.size, self.digest, self.edge = depth, size, digest, edge
        self.least, self.n, self.children, self.leaves, self.saved, self.ends, self.waiting = None, 0, 0, 0, 0, NONE, []

    def add(self, least: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size

    def row(self) -> tuple:
        return self.depth, self.least, self.n, self.children, self.leaves, self.saved, self.ends


def _open(stack: list[Node], key: bytes, lens: list[int], edge: bool) -> None:
    """Push the nodes of a sequence below those that are open; the root first."""
    if not stack:
        stack.append(Node(0, 0, bytes(UNIT), edge))
    for d in range(len(stack), len(lens) + 1):
        digest = hashlib.sha256(stack[-1].digest + key[(d - 1) * UNIT:d * UNIT]).digest()[:UNIT]
        stack.append(Node(d, lens[d - 1], digest, edge))


def local_nodes(stream: Iterator[tuple[int, tuple]]) -> Iterator[tuple[str, object]]:
    """("node", row, parent's smallest member or None, parent's digest or None) as nodes are finished, then ("edge", key, lens, partial figures by depth).

    stream: (turns shared with the row before, (key, lens, least, n, ends)), sorted, without equal keys.
    """
    stack: list[Node] = []
    first = last = None
    own: list[Node] = []

    def close() -> Iterator[tuple]:
        node = stack.pop()
        node.close()
        for row in node.waiting:
            yield "node", row, node.least, None
        parent = stack[-1]
        parent.add(node.least, node.n, 1, node.leaves, node.saved)
        if parent.edge:
            yield "node", node.row(), None, parent.digest
        else:
            parent.waiting.append(node.row())

    for common, (key, lens, least, n, ends) in stream:
        while len(stack) > common + 1:
            if stack[-1].edge:
                stack.pop()
            else:
                yield from close()
        _open(stack, key, lens, first is None)
        if first is None:
            first, own = (key, lens), list(stack)
        stack[-1].add(least, n, 0, 0, 0)
        stack[-1].ends = ends
        last = (key, lens)
    if first is None:
        return
    for node in stack:
        for row in node.waiting:
            yield "node", row, None, node.digest
    yield "edge", *first, [x.row() for x in own]
    if last != first:
        blank = [(x.depth, None, 0, 0, 0, 0, NONE) for x in stack if x.edge]
        yield "edge", *last, blank + [x.row() for x in stack if not x.edge]


def edge_nodes(edges: Iterator[tuple[bytes, list[int], list[tuple]]]) -> Iterator[tuple[bytes, tuple, int | None]]:
    """(digest, row, parent's smallest member) of the nodes on the paths of the tasks' first and last sequences, in order."""
    stack: list[Node] = []
    before = b""

    def close() -> Iterator[tuple]:
        node = stack.pop()
        node.close()
        for digest, row in node.waiting:
            yield digest, row, node.least
        if stack:
            stack[-1].add(node.least, node.n, 1, node.leaves, node.saved)
            stack[-1].waiting.append((node.digest, node.row()))
        else:
            yield node.digest, node.row(), None

    for key, lens, figures in edges:
        common = shared(before, key)
        while len(stack) > common + 1:
            yield from close()
        _open(stack, key, lens, True)
        for node, (_, least, n, children, leaves, saved, ends) in zip(stack, figures, strict=True):
            node.add(least, n, children, leaves, saved)
            node.ends = node.ends if ends == NONE else ends
        before = key
    while stack:
        yield from close()


PART = "_part int, _place int, _key binary, _lens array<bigint>, _up binary, _node binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, _figures array<struct<depth:bigint,least:bigint,n:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"
FIGURE = pa.struct([(k, pa.int64()) for k in ("depth", "least", "n", "children", "leaves", "saved")] + [("ends", pa.string())])
PARTS = pa.schema([("_part", pa.int32()), ("_place", pa.int32()), ("_key", pa.binary()), ("_lens", pa.list_(pa.int64())), ("_up", pa.binary()), ("_node", pa.binary())]
                  + [(k, pa.int64()) for k in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("_figures", pa.list_(FIGURE))])


def _row(part: int = 0, place: int = 0, key=None, lens=None, up=None, digest=None, node=(None,) * 7, parent=None, figures=None) -> tuple:
    depth, least, n, children, leaves, saved, ends = node
    return part, place, key, lens, up, digest, depth, least, parent, n, children, leaves, saved, ends, figures and [dict(zip(FIGURE.names, f, strict=True)) for f in figures]


def _in_batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, PARTS)
            held = []
    if held:
        yield _batch(held, PARTS)


def _of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of one task: nodes that are finished, and two edges."""
    part, runs, place = 0, [], 0
    for batch in batches:
        part = batch["_part"][0].as_py() if batch.num_rows else part
        runs.append(sorted_run(list(zip(*(batch[c].to_pylist() for c in DISTINCT.names), strict=True))))
    for kind, *what in local_nodes(merged(runs)):
        if kind == "node":
            row, parent, up = what
            yield _row(node=row, parent=parent, up=up)
        else:
            key, lens, figures = what
            yield _row(part, place := place + 1, key, lens, figures=figures)


def _of_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    rows = ((k, n, [tuple(f.values()) for f in fs]) for b in batches for k, n, fs in zip(b["_key"].to_pylist(), b["_lens"].to_pylist(), b["_figures"].to_pylist(), strict=True))
    for digest, row, parent in edge_nodes(rows):
        yield _row(digest=digest, node=row, parent=parent)


def prefix_trie(lists: DataFrame, share: int = 100_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node.

    lists: _c and _turns as turn_lists() gives them.  A node is a sequence of first turns; conv_id is its smallest
    member; saved_tokens sums (n_convs - 1) times the code points of the last text over the node's subtree.
    """
    spark = lists.sparkSession
    ship(spark)
    keyed = keep(_keys(lists), "keyed")
    known = keep(distinct_sequences(_packs(keyed)), "sequences")
    tasks = max(parts(spark), known.count() // share + 1)
    ranged = known.repartitionByRange(tasks, "_key").withColumn("_part", F.spark_partition_id())
    first = keep(ranged.mapInArrow(lambda b: _in_batches(_of_task(b)), PART), "nodes")
    edges = first.where(F.col("_key").isNotNull()).repartition(1).sortWithinPartitions("_part", "_place")
    shown = keep(edges.mapInArrow(lambda b: _in_batches(_of_edges(b)), PART), "edges")
    forget(keyed, known)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inside = first.where(F.col("_key").isNull() & F.col("_up").isNull()).select(*names)
    below = first.where(F.col("_up").isNotNull()).drop("parent_conv_id").join(shown.select(F.col("_node").alias("_up"), F.col("conv_id").alias("parent_conv_id")), "_up").select(*names)
    return inside.unionByName(below).unionByName(shown.select(*names))
