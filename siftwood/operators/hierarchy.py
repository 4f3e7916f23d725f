"""Full hierarchies from parent-child links, cycles included.

Rows (id, parent, group) form trees whose links count only within one group. The
rows are laid out in order of group and id and cut into blocks of bounded size, so
that a group of any size is spread over as many tasks as it needs. One way serves
all sizes:

- Within a block, leaves are peeled until only the circles remain; an Euler tour is
  laid over the forest that is left, and list ranking by pointer doubling gives
  every arc its place on the tour. The places of a node's two arcs are its entry
  and exit: depth, root, ancestors and descendants follow from these intervals.
- A tree whose uppermost link leads into another block of its group is a stub. Stubs
  link whole trees, and pointer doubling over them, in joins that finished stubs
  leave, tells how each goes on: its steps, top and path. Circles that run through
  several blocks show as walks that never end; they are cut open, like those within
  a block, and the blocks are solved once more.
- Each tour falls apart where stubs hang in it. Ranking these segments by weighted
  doubling joins gives the tours of whole trees.

Every node gets a state: 'ok' if its walk upwards ends at a node without parent,
'broken' if the parent there has no row, 'crossing' if the parent is in another
group, 'cycle' if the walk never ends. root_id is the last node reached; for
'cycle' it is the smallest id on the circle, and depth counts the steps to it.

Defined results: rows without id are left out; of repeated rows of an id one
counts (the one with the smallest group and parent, if they differ); a null
group is a group of its own, the nodes without group; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.session import materialize

#: Rows of a block, which a task solves in one go.
BLOCK_ROWS = 200_000
#: Parts into which the stubs that hang at one place are spread where they are put in order.
SIBLING_BLOCKS = 64


@dataclass
class Solved:
    """One entry per node of a block: positions count from 0 within it."""

    root: np.ndarray
    depth: np.ndarray
    cycle: np.ndarray
    tree: np.ndarray
    entry: np.ndarray
    leave: np.ndarray


def ranks(successor: np.ndarray) -> np.ndarray:
    """Steps from each element of a set of lists to the end of its list, by pointer doubling.

    The last element of a list is its own successor.
    """
    after = successor.copy()
    dist = (after != np.arange(len(after))).astype(np.int64)
    while True:
        step = dist[after]
        if not step.any():
            return dist
        dist += step
        after = after[after]


def circles(parent: np.ndarray) -> np.ndarray:
    """Which nodes are left when leaves are peeled again and again: those on circles.

    parent has -1 where there is none.
    """
    n = len(parent)
    children = np.bincount(parent[parent >= 0], minlength=n)
    gone = np.zeros(n, bool)
    leaves = np.flatnonzero(children == 0)
    while len(leaves):
        gone[leaves] = True
        above = parent[leaves]
        above = above[above >= 0]
        if len(above) < 64:
            np.subtract.at(children, above, 1)
            above = np.unique(above)
        else:
            above, times = np.unique(above, return_counts=True)
            children[above] -= times
        leaves = above[children[above] == 0]
    return ~gone


def solve(ids: np.ndarray, parent: np.ndarray, ring: np.ndarray | None = None) -> Solved:
    """Roots, depths and Euler intervals of a forest with circles; parent holds positions, -1 for none.

    ring names the smallest id of a circle for the nodes known to be on one that
    leaves the block, -1 for all others.

    Entry and exit number the arcs of one tree from 0; a tree hanging off a circle
    is numbered from the node of the circle that it hangs off.
    """
    n = len(ids)
    known = ring >= 0 if ring is not None else np.zeros(n, bool)
    parent = np.where(known, -1, parent)
    on_circle = circles(parent)
    on_circle &= ~known
    up = np.where(on_circle, -1, parent)  # every circle is cut open: its nodes become roots
    here = np.arange(n)
    # children in order of parent, then id
    order = np.lexsort((ids, up))
    order = order[np.searchsorted(up[order], 0) :] if n else order
    first = np.full(n, -1)
    follows = np.full(n, -1)
    if len(order):
        same = up[order[1:]] == up[order[:-1]]
        follows[order[:-1][same]] = order[1:][same]
        starts = np.r_[True, ~same]
        first[up[order[starts]]] = order[starts]
    # arcs: v goes down into node v, n + v comes back up out of it
    down = np.where(first >= 0, first, n + here)
    back = np.where(follows >= 0, follows, np.where(up >= 0, n + up, n + here))
    rank = ranks(np.r_[down, back])
    tops = np.flatnonzero(up < 0)
    # the tours one behind the other: length of a tour = rank of its first arc + 1
    length = rank[tops] + 1
    begin = np.cumsum(length) - length
    arcs = np.empty(2 * n, np.int64)
    ends = np.full(2 * n, -1)
    ends[n + tops] = begin + length - 1
    # each arc's tour end: carried along by the rank order
    tour_end = _tour_end(np.r_[down, back], ends)
    place = tour_end - rank
    arcs[place] = np.arange(2 * n)
    step = np.where(arcs < n, 1, -1)
    depth = np.empty(n, np.int64)
    is_down = arcs < n
    depth[arcs[is_down]] = np.cumsum(step)[is_down] - 1
    top_at = np.repeat(tops, length)
    tree = np.empty(n, np.int64)
    tree[arcs[is_down]] = top_at[is_down]
    offset = np.repeat(begin, length)
    entry, leave = np.empty(n, np.int64), np.empty(n, np.int64)
    entry[arcs[is_down]] = (np.arange(2 * n) - offset)[is_down]
    leave[arcs[~is_down] - n] = (np.arange(2 * n) - offset)[~is_down]
    root = ids[tree].copy() if n else ids.copy()
    cycle = (on_circle | known)[tree] if n else np.zeros(0, bool)
    least = _least_on_circle(ids, parent, on_circle) if on_circle.any() else ids.copy()
    if ring is not None:
        least[known] = ring[known]
    root[cycle] = least[tree[cycle]]
    return Solved(root, depth, cycle, tree, entry, leave)


def _tour_end(successor: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of the last arc of each arc's tour, by pointer doubling."""
    after = successor.copy()
    while True:
        further = after[after]
        if (further == after).all():
            return ends[after]
        after = further


def _least_on_circle(ids: np.ndarray, parent: np.ndarray, on_circle: np.ndarray) -> np.ndarray:
    """The smallest id on the circle of each node on one, by pointer doubling."""
    nodes = np.flatnonzero(on_circle)
    place = np.full(len(ids), -1)
    place[nodes] = np.arange(len(nodes))
    after, least = place[parent[nodes]], ids[nodes].copy()
    for _ in range(max(1, int(len(nodes)).bit_length())):
        least = np.minimum(least, least[after])
        after = after[after]
    out = ids.copy()
    out[nodes] = least
    return out


def _positions(ids: np.ndarray, group: np.ndarray, parent: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Where each parent lies among the ids of a block; -1 if it isn't there."""
    by_id = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[by_id], parent)
    at = np.minimum(at, max(0, len(ids) - 1))
    found = by_id[at] if len(ids) else at
    ok = has & (ids[found] == parent) & (group[found] == group) if len(ids) else has
    return np.where(ok, found, -1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a partition, which come in order of (grp, id), in blocks; a block ends where a group does, if it can."""
    kept: list[dict[str, np.ndarray]] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        low = np.iinfo(np.int64).min
        part = {
            "grp": batch.column("grp").fill_null(low).to_numpy(),
            "none": batch.column("grp").is_null().to_numpy(zero_copy_only=False),
            "id": batch.column("id").to_numpy(),
            "has": batch.column("parent").is_valid().to_numpy(zero_copy_only=False),
            "parent": batch.column("parent").fill_null(0).to_numpy(),
            "ring": batch.column("ring").fill_null(low).to_numpy(),
            "label": np.array(batch.column("label").to_pylist(), object),
        }
        kept.append(part)
        have += batch.num_rows
        while have >= rows:
            whole = {k: np.concatenate([p[k] for p in kept]) for k in part}
            cut = int(np.searchsorted(whole["grp"][:rows], whole["grp"][rows - 1], side="left")) or rows
            yield {k: v[:cut] for k, v in whole.items()}
            kept = [{k: v[cut:] for k, v in whole.items()}]
            have -= cut
    if have:
        yield {k: np.concatenate([p[k] for p in kept]) for k in kept[0]}


_LOCAL = "grp bigint, id bigint, parent bigint, root_id bigint, depth int, cycle boolean, top bigint, up bigint, entry bigint, leave bigint"


def _path_lists(found: Solved, values: np.ndarray) -> list[list]:
    """The values from the top of its tree down to each node: in order of entry the open ancestors are a stack."""
    out: list[list] = [[] for _ in values]
    stack: list = []
    for i in np.lexsort((found.entry, found.tree)):
        del stack[found.depth[i] :]
        stack.append(values[i])
        out[i] = list(stack)
    return out


def _local(nodes: DataFrame, rows: int, path: str | None) -> DataFrame:
    """The nodes of every block with root, depth and tour within it; up is the parent of an uppermost node that the block lacks."""
    kind = {"names": pa.string(), "ids": pa.int64(), None: None}[path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, rows):
            ids, ring = b["id"], b["ring"]
            known = ring != np.iinfo(np.int64).min
            low = int(ring[known].min()) if known.any() else 0
            # ids may be negative, so rings are told by their distance from the smallest
            found = solve(ids, _positions(ids, b["grp"], b["parent"], b["has"]), np.where(known, ring - low, -1) if known.any() else None)
            root = found.root
            if known.any():
                root = np.where(known[found.tree], ring[found.tree], root)
            top = found.tree
            open_top = b["has"][top] & ~found.cycle
            columns = [
                pa.array(b["grp"], mask=b["none"]), pa.array(ids), pa.array(b["parent"], mask=~b["has"]), pa.array(root), pa.array(found.depth.astype(np.int32)), pa.array(found.cycle),
                pa.array(ids[top]), pa.array(b["parent"][top], mask=~open_top), pa.array(found.entry), pa.array(found.leave),
            ]
            names = [c.split()[0] for c in _LOCAL.split(", ")]
            if path:
                columns.append(pa.array(_path_lists(found, b["label"] if path == "names" else ids.astype(object)), pa.list_(kind)))
                names.append("path")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _LOCAL + {"names": ", path array<string>", "ids": ", path array<bigint>", None: ""}[path]
    ordered = nodes.select("grp", "id", "parent", "ring", "label").repartitionByRange("grp", "id").sortWithinPartitions("grp", "id")
    return materialize(ordered.mapInArrow(run, schema), "blocks")


def _nodes(df: DataFrame, node: str, parent: str, group: str, label: str | None) -> DataFrame:
    picked = df.select(
        F.col(f"`{group}`").cast("bigint").alias("grp"),
        F.col(f"`{node}`").cast("bigint").alias("id"),
        F.col(f"`{parent}`").cast("bigint").alias("parent"),
        (F.col(f"`{label}`") if label else F.lit(None)).cast("string").alias("label"),
    ).where("id is not null")
    # one row of an id; equal rows, as they mostly are, fold before the shuffle
    least = F.min(F.struct("grp", "parent", "label"))
    return picked.groupBy("id").agg(least.alias("row")).select("row.grp", "id", "row.parent", "row.label", F.lit(None).cast("bigint").alias("ring"))


def _ends(local: DataFrame) -> DataFrame:
    """Every uppermost node t whose parent its block lacks: kind, and for a stub the tree, place and depth of that parent."""
    asked = local.where("id = top and up is not null").select(F.col("id").alias("t"), "up", F.col("grp").alias("t_grp"))
    extra = ["path"] if "path" in local.columns else []
    wanted = asked.select(F.col("up").alias("wanted")).distinct()
    there = local.join(wanted, F.col("id") == F.col("wanted")).select("wanted", "grp", "top", "depth", "entry", "leave", *extra)
    same = F.col("grp").eqNullSafe(F.col("t_grp"))
    kind = F.when(F.col("wanted").isNull(), "broken").when(same, "stub").otherwise("crossing")
    told = asked.join(there, F.col("up") == F.col("wanted"), "left")
    return materialize(
        told.select("t", kind.alias("kind"), F.col("top").alias("host"), F.col("leave").alias("place"), F.col("entry").alias("p_entry"), (F.col("depth") + 1).alias("steps"), *extra), "ends"
    )


def _doubled(state: DataFrame, label: str, keys: list[str], merged: Callable[[DataFrame], list], most: int | None = None) -> DataFrame:
    """Let every open row take over what the row that it points at (next_...) has come to, until none is open; rows that are done leave the join."""
    columns = state.columns
    for _ in range(most if most is not None else 64):
        if not state.where("open").limit(1).count():
            break
        other = state.select(*[F.col(c).alias(f"o_{c}") for c in columns])
        meets = [F.col(f"next_{k}") == F.col(f"o_{k}") for k in keys]
        on = meets[0] if len(meets) == 1 else meets[0] & meets[1]
        moved = state.where("open").join(other, on).select(*merged(columns))
        state = materialize(state.where("not open").unionByName(moved), label)
    return state


def _walks(stubs: DataFrame, most: int | None = None) -> DataFrame:
    """t, next_t, steps (and path) of every stub, doubled until next_t is no stub, or `most` times."""
    own = stubs.select(F.col("t").alias("known"))
    extra = ["path"] if "path" in stubs.columns else []
    start = stubs.join(own, F.col("host") == F.col("known"), "left").select(
        "t", F.col("host").alias("next_t"), F.col("steps").cast("int").alias("steps"), F.col("known").isNotNull().alias("open"), F.col("t").alias("least"), *extra
    )

    def merged(columns: list[str]) -> list:
        out = ["t", F.col("o_next_t").alias("next_t"), (F.col("steps") + F.col("o_steps")).alias("steps"), F.col("o_open").alias("open"), F.least("least", "o_least").alias("least")]
        return out + ([F.concat("o_path", "path").alias("path")] if extra else [])

    return _doubled(materialize(start, "walks"), "walks", ["t"], merged, most)


def _rings(local: DataFrame, stubs: DataFrame, n: int) -> DataFrame | None:
    """id and ring, the smallest id on its circle, of the nodes on circles that run through several blocks; None if there are none."""
    plain = stubs.drop("path")
    # after more steps than there are stubs, a walk that goes on is on its circle
    walked = _walks(plain.withColumn("steps", F.lit(0)), most=n.bit_length())
    ring = walked.where("open").select(F.col("next_t").alias("t")).distinct()
    if not ring.limit(1).count():
        return None
    ring = ring.join(walked.select("t", F.col("least").alias("circle")), "t").join(plain, "t").select("t", "circle", "host", F.col("p_entry"), "place")
    # on the circle lie, in the tree that a stub hangs in, its parent and what is above it there
    on = (F.col("top") == F.col("host")) & (F.col("entry") <= F.col("p_entry")) & (F.col("leave") >= F.col("place"))
    nodes = materialize(local.join(ring, on).select("id", "circle"), "rings")
    least = nodes.groupBy("circle").agg(F.min("id").alias("ring"))
    return materialize(nodes.join(least, "circle").select("id", "ring"), "rings")


def _tours(local: DataFrame, stubs: DataFrame) -> DataFrame:
    """id, entry and leave in the tours of whole trees, for the nodes of all trees that hang together with others."""
    inside = F.pmod(F.xxhash64("t"), F.lit(SIBLING_BLOCKS)).cast("int")
    hung = stubs.select("t", "host", "place", inside.alias("b"))
    placed = hung.withColumn("next", F.lead("t").over(Window.partitionBy("host", "place", "b").orderBy("t")))
    heads = hung.groupBy("host", "place", "b").agg(F.min("t").alias("head"))
    # at most SIBLING_BLOCKS rows for each place in a block's tree
    across = Window.partitionBy("host").orderBy("place", "b")
    heads = materialize(heads.select("*", F.lead("head").over(across).alias("next_head"), F.lead("place").over(across).alias("next_place"), F.row_number().over(across).alias("k")), "heads")
    after = placed.join(heads.select("host", "place", "b", "next_head", "next_place"), ["host", "place", "b"]).select(
        "t", "host", "place", F.coalesce("next", "next_head").alias("next"), F.when(F.col("next").isNotNull(), F.col("place")).otherwise(F.col("next_place")).alias("next_place")
    )
    first = heads.where("k = 1").select(F.col("host").alias("tree"), F.col("head").alias("next"), F.col("place").alias("next_place"))
    trees = stubs.select(F.col("t").alias("tree"), F.lit(True).alias("stub")).unionByName(stubs.select(F.col("host").alias("tree"), F.lit(False).alias("stub"))).groupBy("tree").agg(F.max("stub").alias("stub"))
    length = local.where("id = top").select(F.col("id").alias("tree"), (F.col("leave") + 1).alias("length"))
    trees = materialize(trees.join(length, "tree"), "trees")
    # a tour's segments: the first of each tree (side 0), and one behind each stub that hangs in it (side 1)
    zero = F.lit(0).cast("bigint")
    begin = trees.join(first, "tree", "left").select(F.col("tree").alias("t"), F.lit(0).alias("side"), "tree", zero.alias("start"), "next", "next_place", "length", "stub")
    behind = after.join(trees.withColumnRenamed("tree", "host"), "host").select("t", F.lit(1).alias("side"), F.col("host").alias("tree"), F.col("place").alias("start"), "next", "next_place", "length", "stub")
    segments = begin.unionByName(behind)
    goes_down, goes_back = F.col("next").isNotNull(), F.col("next").isNull() & F.col("stub")
    segments = materialize(
        segments.select(
            "t", "side", "tree", "start",
            F.when(goes_down, F.col("next")).when(goes_back, F.col("tree")).alias("next_t"),
            F.when(goes_down, 0).when(goes_back, 1).alias("next_side"),
            (F.coalesce("next_place", "length") - F.col("start")).alias("weight"),
        ), "segments"
    )
    state = segments.select("t", "side", "next_t", "next_side", F.col("weight").alias("rank"), F.when(F.col("next_t").isNull(), F.col("tree")).alias("whole"), F.col("next_t").isNotNull().alias("open"))

    def merged(columns: list[str]) -> list:
        return ["t", "side", F.col("o_next_t").alias("next_t"), F.col("o_next_side").alias("next_side"), (F.col("rank") + F.col("o_rank")).alias("rank"), F.col("o_whole").alias("whole"), F.col("o_open").alias("open")]

    ranked = _doubled(materialize(state, "ranks"), "ranks", ["t", "side"], merged)
    # arcs behind the start of a segment, out of all of its whole tour
    total = ranked.join(trees.where("not stub").select(F.col("tree").alias("t")), "t", "left_semi").where("side = 0").select(F.col("whole").alias("w"), F.col("rank").alias("total"))
    begins = ranked.join(total, F.col("whole") == F.col("w")).select("t", "side", (F.col("total") - F.col("rank")).alias("begin"))
    # of the segments that start at one place only the last isn't empty
    known = segments.join(begins, ["t", "side"]).groupBy("tree", "start").agg(F.max("begin").alias("begin"))
    marks = known.select("tree", F.col("start").alias("x"), F.lit(0).alias("what"), F.lit(None).cast("bigint").alias("id"), F.struct("start", "begin").alias("mark"))
    moved = local.join(trees.select("tree"), F.col("top") == F.col("tree"))
    arcs = moved.select("tree", "id", F.explode(F.array(F.struct(F.lit(1).alias("what"), F.col("entry").alias("x")), F.struct(F.lit(2).alias("what"), F.col("leave").alias("x")))).alias("a"))
    arcs = arcs.select("tree", "a.x", "a.what", "id", F.lit(None).cast("struct<start:bigint,begin:bigint>").alias("mark"))
    # as-of along a tree of one block, so a window is as large as a block at most
    along = Window.partitionBy("tree").orderBy("x", "what").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(arcs).withColumn("m", F.last("mark", ignorenulls=True).over(along)).where("id is not null")
    at = F.col("m.begin") + F.col("x") - F.col("m.start")
    return found.groupBy("id").agg(F.max(F.when(F.col("what") == 1, at)).alias("entry"), F.max(F.when(F.col("what") == 2, at)).alias("leave"))


def _whole(df: DataFrame, node: str, parent: str, group: str, rows: int, *, tours: bool = False, path: str | None = None, name: str | None = None) -> DataFrame:
    """grp, id, parent, root_id, depth, cycle, top, ends ('broken', 'crossing' or null), and entry, leave, path as asked for."""
    nodes = _nodes(df, node, parent, group, name)
    local = _local(nodes, rows, path)
    ends = _ends(local)
    stubs = ends.where("kind = 'stub'")
    n = stubs.count()
    rings = _rings(local, stubs, n) if n else None
    if rings is not None:
        marked = nodes.drop("ring").join(rings, "id", "left")
        local = _local(marked, rows, path)
        ends = _ends(local)
        stubs = ends.where("kind = 'stub'")
        n = stubs.count()
    base = [c for c in ("grp", "id", "parent", "cycle", "entry", "leave") if tours or c not in ("entry", "leave")]
    over = ends.where("kind <> 'stub'").select(F.col("t").alias("top"), F.col("kind").alias("ends"))
    if not n:
        return local.join(over, "top", "left").select(*base, "root_id", "depth", "top", "ends", *(["path"] if path else []))
    walks = _walks(stubs).select(F.col("t").alias("w_t"), F.col("next_t").alias("w_top"), F.col("steps").alias("w_steps"), *([F.col("path").alias("w_path")] if path else []))
    # what the tops of whole trees are
    tops = local.where("id = top").select(F.col("id").alias("final"), F.col("root_id").alias("f_root"), F.col("cycle").alias("f_cycle"))
    walks = materialize(walks.join(tops, F.col("w_top") == F.col("final")).drop("final"), "walks")
    out = local.join(walks, F.col("top") == F.col("w_t"), "left").select(
        *[c for c in base if c != "cycle"],
        F.coalesce("f_root", "root_id").alias("root_id"),
        (F.col("depth") + F.coalesce("w_steps", F.lit(0))).cast("int").alias("depth"),
        F.coalesce("f_cycle", "cycle").alias("cycle"),
        F.coalesce("w_top", "top").alias("top"),
        *([F.when(F.col("w_path").isNull(), F.col("path")).otherwise(F.concat("w_path", "path")).alias("path")] if path else []),
    )
    out = out.join(over, "top", "left")
    if tours:
        told = _tours(local, stubs).select(F.col("id").alias("t_id"), F.col("entry").alias("t_entry"), F.col("leave").alias("t_leave"))
        out = out.join(told, F.col("id") == F.col("t_id"), "left").withColumns({"entry": F.coalesce("t_entry", "entry"), "leave": F.coalesce("t_leave", "leave")}).drop("t_id", "t_entry", "t_leave")
    return out


def intervals(df: DataFrame, node: str = "symbol_id", parent: str = "parent_id", group: str = "file_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, parent, root_id, depth, cycle, top, ends, entry and leave of every node.

    top is the uppermost node of its own tree (for a tree on a circle the node of
    the circle); d is below a exactly if top is the same and a.entry < d.entry and
    d.leave < a.leave, or a is on a circle and d belongs to another tree of it.
    """
    return _whole(df, node, parent, group, block_rows, tours=True).select("id", "parent", "root_id", "depth", "cycle", "top", "ends", "entry", "leave")


def _state():
    return F.when(F.col("cycle"), "cycle").when(F.col("ends").isNotNull(), F.col("ends")).when(F.col("parent").isNull(), "root").otherwise("ok")


def found(df: DataFrame, node: str = "symbol_id", parent: str = "parent_id", group: str = "file_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per node with a parent: node, root_id, depth, state."""
    rows = _whole(df, node, parent, group, block_rows).where("parent is not null")
    return rows.select(F.col("id").alias(node), "root_id", "depth", _state().alias("state"))


def descendants(df: DataFrame, node: str = "symbol_id", parent: str = "parent_id", group: str = "file_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, root_id, depth, state, top, entry, leave, circle and n_below of every node.

    The nodes below a node are those with the same top whose entry and leave lie
    within its own; circle is root_id for the nodes on a circle, and below such a
    node are also all other nodes with state 'cycle' and that root_id. n_below is
    their number: the width of the interval, or all of the circle but the node.
    """
    solved = materialize(intervals(df, node, parent, group, block_rows=block_rows), "tours")
    sizes = solved.where("cycle").groupBy("root_id").agg(F.count(F.lit(1)).alias("around"))
    sizes = sizes.select(F.col("root_id").alias("r"), "around")
    circle = F.when(F.col("cycle") & (F.col("depth") == 0), F.col("root_id"))
    below_it = F.when(circle.isNotNull(), F.col("around") - 1).otherwise((F.col("leave") - F.col("entry") - 1) / 2)
    told = solved.join(sizes, circle == F.col("r"), "left")
    return told.select(F.col("id").alias(node), "root_id", "depth", _state().alias("state"), "top", "entry", "leave", circle.alias("circle"), below_it.cast("bigint").alias("n_below"))


def pairs(df: DataFrame, ancestors: DataFrame, node: str = "symbol_id", parent: str = "parent_id", group: str = "file_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ancestor and node for every node below one of the given ancestors, by interval containment within a tree."""
    solved = materialize(intervals(df, node, parent, group, block_rows=block_rows).select("id", "root_id", "depth", "cycle", "top", "entry", "leave"), "tours")
    a = ancestors.select(F.col(f"`{node}`").cast("bigint").alias("a_id")).distinct()
    a = a.join(solved, F.col("a_id") == F.col("id")).select(
        "a_id", F.col("top").alias("a_top"), F.col("entry").alias("a_entry"), F.col("leave").alias("a_leave"), F.when(F.col("cycle") & (F.col("depth") == 0), F.col("root_id")).alias("a_circle")
    )
    inside = (F.col("top") == F.col("a_top")) & (F.col("entry") > F.col("a_entry")) & (F.col("leave") < F.col("a_leave"))
    # from a node of a circle, the other trees on it are below too
    around = F.col("cycle") & (F.col("root_id") == F.col("a_circle")) & (F.col("top") != F.col("a_top"))
    told = solved.join(a, inside).unionByName(solved.join(a, around))
    return told.select(F.col("a_id").alias("ancestor"), F.col("id").alias(node))


def below(df: DataFrame, node: str = "symbol_id", parent: str = "parent_id", group: str = "file_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node and below_id for every node and every node below it: as many rows as all depths together.

    On a circle every node is below every other, and so are the trees that hang off
    it. No node is below itself.
    """
    solved = _whole(df, node, parent, group, block_rows, path="ids").select("id", "root_id", "depth", "cycle", "top", "path")
    solved = materialize(solved, "paths")
    trees = solved.select(F.explode("path").alias("symbol"), F.col("id").alias("below")).where("symbol <> below")
    ring = solved.where("cycle and depth = 0").select(F.col("id").alias("symbol"), F.col("root_id").alias("circle"))
    around = solved.where("cycle").join(ring, (F.col("root_id") == F.col("circle")) & (F.col("symbol") != F.col("top")))
    told = trees.unionByName(around.select("symbol", F.col("id").alias("below")))
    return told.select(F.col("symbol").alias(node), F.col("below").alias("below_id"))


def paths(df: DataFrame, node: str = "symbol_id", parent: str = "parent_id", group: str = "file_id", name: str = "name", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """node, root_id, depth and path, the names from the top of its tree down to it, as an array.

    Names may hold any separator, so they are not joined. A path in a tree on a
    circle begins at the node of the circle. Names of repeated rows: the smallest.
    """
    solved = _whole(df, node, parent, group, block_rows, path="names", name=name)
    return solved.select(F.col("id").alias(node), "root_id", "depth", "path")
