"""Graph operators over links (src, dst): reach, components, centrality, circles, entry points.

Each runs in rounds of joins and writes its state between two rounds, so that no
plan grows with the rounds and a lost executor costs one round. Nodes are ids;
loops and repeated links do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwood.functions import paths as P
from siftwood.index import Index
from siftwood.operators import reads
from siftwood.session import materialize


#: Written tables that are read side by side before they are written as one.
SEEN_TABLES = 8
#: Steps of a reach between two written tables.
STEPS_AT_ONCE = 3


def reach(links: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """id and depth of every node that the links lead to from starts (id), the starts themselves left out; depth is the least number of steps."""
    links = materialize(links.select("src", "dst").where("src <> dst").distinct(), "links")
    edge = seen = materialize(starts.select(F.col("id").cast("bigint").alias("id"), F.lit(0).alias("depth")).distinct(), "reach")
    depth = tables = 0
    while most is None or depth < most:
        known, now, new = seen, edge, None
        last = depth + STEPS_AT_ONCE if most is None else min(most, depth + STEPS_AT_ONCE)
        for step in range(depth + 1, last + 1):
            now = links.join(now, links.src == now.id, "left_semi").select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti").select("id", F.lit(step).alias("depth"))
            known = known.unionByName(now)
            new = now if new is None else new.unionByName(now)
        new = materialize(new, "edge")
        top = new.agg(F.max("depth")).first()[0]
        if top is None:
            break
        seen, tables = seen.unionByName(new), tables + 1
        if top < last:
            break
        depth, edge = last, new.where(F.col("depth") == last)
        if tables % SEEN_TABLES == 0:  # a union of a few written tables, then one table again
            seen = materialize(seen, "reach")
    return seen.where("depth > 0")


def dependents(index: Index, path: str) -> DataFrame:
    """rel_path and depth of the files that need a file, directly or not."""
    start = index.files.where(F.col("rel_path") == path).select(F.col("file_id").alias("id"))
    found = reach(index.file_edges().select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)
    return found.join(index.paths, F.col("id") == F.col("file_id")).select("rel_path", "depth")


def ancestors(index: Index, path: str) -> DataFrame:
    """rel_path and depth of the files that a file needs."""
    start = index.files.where(F.col("rel_path") == path).select(F.col("file_id").alias("id"))
    return reach(index.file_edges(), start).join(index.paths, F.col("id") == F.col("file_id")).select("rel_path", "depth")


def neighbours(index: Index, path: str, limit: int = 20) -> DataFrame:
    links = index.links().where(F.col("src_path") != F.col("dst_path"))
    one = links.where(F.col("src_path") == path).select(F.col("dst_path").alias("rel_path"))
    two = links.where(F.col("dst_path") == path).select(F.col("src_path").alias("rel_path"))
    return one.union(two).distinct().orderBy("rel_path").limit(limit)


def blast(found: DataFrame, top: int = 15) -> DataFrame:
    """subsystem and files of the dependents, the largest first, with total and direct beside each."""
    n = found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct")).first()
    rows = found.groupBy(P.subsystem(F.col("rel_path")).alias("subsystem")).agg(F.count(F.lit(1)).alias("files"))
    return rows.orderBy(F.desc("files"), "subsystem").limit(top).select("subsystem", "files", F.lit(n.total).alias("total"), F.lit(n.direct).alias("direct"))


def entrypoints_for(index: Index, path: str, limit: int = 20) -> DataFrame:
    """The dependents of a file at which nothing points, the shallowest first; the file itself if it has no dependents."""
    found = dependents(index, path).select("rel_path")
    own = index.paths.where(F.col("rel_path") == path).select("rel_path")
    pool = found if found.limit(1).count() else own
    hit = index.edges.where(F.col("resolved") & (F.col("dst_type") == "file") & F.col("kind").isin(*P.DEPENDENCY_KINDS)).select(F.col("dst_id").alias("file_id"))
    rows = pool.join(index.paths, "rel_path").join(hit, "file_id", "left_anti") if found.limit(1).count() else own
    return rows.select("rel_path").orderBy(P.depth(F.col("rel_path")), "rel_path").limit(limit)


def tests_for(index: Index, path: str, limit: int = 25) -> DataFrame:
    """Tests in the folder of a file, else tests that need it; those named after it first."""
    files = index.paths.where((F.col("rel_path") != path) & P.is_test(F.col("rel_path")))
    near = files.where(P.dirname(F.col("rel_path")) == P.dirname(F.lit(path)))
    using = reads.incoming(index, path).select(F.col("file").alias("rel_path")).distinct().join(files, "rel_path", "left_semi")
    rows = near.select("rel_path") if near.limit(1).count() else using
    stem, own = F.lower(P.stem(F.col("rel_path"))), F.lower(P.stem(F.lit(path)))
    covers = (stem == own) | (F.regexp_replace(stem, "(_test|_spec|test)$", "") == own) | (F.regexp_replace(stem, "^(test_|spec_)", "") == own)
    return rows.select("rel_path", covers.alias("covers")).orderBy(F.desc("covers"), "rel_path").limit(limit)


#: Rounds of centrality between two written tables.
ROUNDS_AT_ONCE = 4


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 40) -> DataFrame:
    """id, score and in_degree after a fixed number of rounds.

    Repeated links count as often as they stand; loops and links to unknown nodes
    are left out; what nodes without links hold is spread over all. How much that
    is in the coming rounds follows from a few sums now: with e_0 marking the nodes
    without links and e_i what they get of a node's score i rounds later, the sums of
    score times e_i tell it, so several rounds make one plan without a look in between.
    """
    nodes = materialize(nodes.select(F.col("id").cast("bigint").alias("id")).distinct(), "nodes")
    known = links.select("src", "dst").where("src <> dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    weighted = materialize(known.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "weighted")
    out = weighted.groupBy("src").agg(F.sum("w").alias("out"))
    shares = materialize(weighted.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")), "shares")
    degree = weighted.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("in_degree"))
    leads = out.select(F.col("src").alias("id"), F.lit(True).alias("leads"))
    base = nodes.join(degree, "id", "left").join(leads, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.when(F.col("leads"), 0.0).otherwise(1.0).alias("e0"))
    base = materialize(base, "base")
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("score"), "in_degree")
    most = min(ROUNDS_AT_ONCE, rounds)
    # e_1, e_2 and so on come from the same links, all moved by one in each step
    ends = base.select("id", F.array("e0").alias("e"))
    for i in range(1, most):
        given = shares.join(ends.select(F.col("id").alias("dst"), "e"), "dst").select(F.col("src").alias("id"), F.lit(0.0).alias("e0"), F.transform("e", lambda x: F.col("share") * x).alias("later"))
        own = base.select("id", "e0", F.array_repeat(F.lit(0.0), i).alias("later"))  # so that every node has a row, without a join
        ends = own.unionByName(given).groupBy("id").agg(F.array(F.sum("e0"), *[F.sum(F.col("later")[j]) for j in range(i)]).alias("e"))
    base = materialize(base.join(ends, "id").select("id", "in_degree", "e"), "ends")
    scores = base.select("id", F.lit(1.0 / n).alias("score"))
    total = base.agg(*[F.sum(F.col("e")[i]) for i in range(most)]).first()
    done = 0
    while done < rounds:
        some = min(most, rounds - done)
        held = list(scores.join(base.select("id", "e"), "id").agg(*[F.sum(F.col("score") * F.col("e")[i]) for i in range(some)]).first())
        for _ in range(some):
            spread = (1 - damping) / n + damping * (held[0] or 0.0) / n
            held = [spread * total[i] + damping * (held[i + 1] or 0.0) for i in range(len(held) - 1)]
            given = shares.join(scores.select(F.col("id").alias("src"), "score"), "src").select(F.col("dst").alias("id"), (F.col("share") * F.col("score")).alias("got"))
            scores = base.select("id", F.lit(0.0).alias("got")).unionByName(given).groupBy("id").agg((F.lit(spread) + damping * F.sum("got")).alias("score"))
        done += some
        scores = materialize(scores, "rank")
    return scores.join(base.select("id", "in_degree"), "id").select("id", "score", "in_degree")


def central_files(index: Index, limit: int = 10) -> DataFrame:
    """rel_path, score and in_degree of the files that most depends on, vendored ones left out after scoring."""
    ranked = pagerank(index.files.select(F.col("file_id").alias("id")), index.links().select("src", "dst"))
    rows = ranked.join(index.paths, F.col("id") == F.col("file_id")).where(~P.is_vendored(F.col("rel_path")))
    return rows.select("rel_path", F.round("score", 9).alias("score"), "in_degree").orderBy(F.desc("score"), F.desc("in_degree"), "rel_path").limit(limit)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and component, the smallest id of the connected component, by alternating star contraction.

    Each round turns every node's links to its smallest neighbour; a hot node is
    handled by sums over its links, never gathered.
    """
    pairs = materialize(links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct(), "pairs")
    while True:
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: the smaller neighbours and the node itself go to the smallest
        small_least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(small_least, F.col("b") == F.col("u")).select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("a").alias("y")), F.struct(F.col("m").alias("x"), F.col("b").alias("y")))).alias("p"))
        after = materialize(small.select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a <> b").distinct(), "pairs")
        changed = after.join(pairs, ["a", "b"], "left_anti").limit(1).count() or pairs.join(after, ["a", "b"], "left_anti").limit(1).count()
        pairs = after
        if not changed:
            break
    label = pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    return nodes.select(F.col("id").cast("bigint").alias("id")).distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters(index: Index) -> DataFrame:
    """component, files, label, lang and first of the groups of linked files, single files left out.

    One component that holds 25 files and 70 % of all clustered ones is split by
    subsystem, groups of one left out. The label is the commonest subsystem.
    """
    ids = index.paths.select(F.col("rel_path"), F.col("file_id"))
    shared = reads.shared_resource_links(index)
    to_id = lambda df: df.join(ids.select(F.col("rel_path").alias("src_path"), F.col("file_id").alias("src")), "src_path").join(ids.select(F.col("rel_path").alias("dst_path"), F.col("file_id").alias("dst")), "dst_path")
    links = index.links().select("src", "dst").unionByName(to_id(shared).select("src", "dst"))
    member = components(index.files.select(F.col("file_id").alias("id")), links)
    rows = member.join(index.files.select("file_id", "rel_path", "lang"), F.col("id") == F.col("file_id")).withColumn("subsystem", P.subsystem(F.col("rel_path")))
    rows = materialize(rows.select("component", "rel_path", "lang", "subsystem"), "members")
    sizes = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    top = sizes.orderBy(F.desc("n"), "component").limit(1).first()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    key = F.col("component").cast("string")
    if top and top.n >= 25 and top.n * 100 >= total * 70 and rows.where(F.col("component") == top.component).select("subsystem").distinct().limit(2).count() == 2:
        key = F.when(F.col("component") == top.component, F.concat_ws(":", key, "subsystem")).otherwise(key)
    rows = rows.withColumn("cluster", key)

    def commonest(column: str) -> DataFrame:
        counted = rows.groupBy("cluster", column).agg(F.count(F.lit(1)).alias("k"))
        best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("k"), column))
        return counted.withColumn("r", best).where("r = 1").select("cluster", F.col(column))

    told = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("files"), F.min("rel_path").alias("first")).where("files >= 2")
    label = F.when(F.col("subsystem") == ".", "misc").otherwise(F.col("subsystem"))
    return told.join(commonest("subsystem"), "cluster").join(commonest("lang"), "cluster").select("cluster", "files", label.alias("label"), "lang", "first")


def circles(links: DataFrame) -> DataFrame:
    """id and circle of the nodes on a circle: the strongly connected components with two nodes or more, by their smallest id.

    Nodes without a way in or out are peeled first. Then every node learns the
    smallest id that reaches it and the smallest that it reaches: where both are the
    same, it is on a circle with that node. The rest goes on with the links between
    nodes that have both ids in common.
    """
    links = materialize(links.select("src", "dst").where("src <> dst").distinct(), "ring")
    size = links.count()
    while True:
        kept = links.join(links.select(F.col("dst").alias("src")), "src", "left_semi").join(links.select(F.col("src").alias("dst")), "dst", "left_semi")
        links = materialize(kept, "ring")
        before, size = size, links.count()
        if size == before:
            break
    done = None
    while size:
        nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
        state = materialize(nodes.select("id", F.col("id").alias("f"), F.col("id").alias("b"), F.lit(True).alias("moved")), "color")
        while state.where("moved").limit(1).count():
            # the smallest id that reaches a node, and the smallest that it reaches
            into = links.join(state, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("i")).agg(F.min("f").alias("g"))
            out = links.join(state, F.col("dst") == F.col("id")).groupBy(F.col("src").alias("o")).agg(F.min("b").alias("h"))
            f, b = F.least("f", F.coalesce("g", "f")), F.least("b", F.coalesce("h", "b"))
            both = state.join(into, F.col("id") == F.col("i"), "left").join(out, F.col("id") == F.col("o"), "left")
            state = materialize(both.select("id", f.alias("f"), b.alias("b"), ((f < F.col("f")) | (b < F.col("b"))).alias("moved")), "color")
        found = materialize(state.where("f = b").select("id", F.col("f").alias("c")), "found")
        done = found if done is None else done.unionByName(found)
        # what is on one circle has both ids in common
        left = state.where("f <> b")
        x, y = left.select(F.col("id").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), left.select(F.col("id").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        links = materialize(links.join(x, "src").join(y, "dst").where("f1 = f2 and b1 = b2").select("src", "dst"), "ring")
        size = links.count()
    if done is None:
        return links.select(F.col("src").alias("id"), F.col("dst").alias("circle")).limit(0)
    size = done.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return done.join(size, "c", "left_semi").select("id", F.col("c").alias("circle"))


def include_cycles(index: Index) -> DataFrame:
    """rel_path and circle of the files that include each other in a ring; circle is the path of its smallest file_id."""
    found = circles(index.file_edges(("includes",)))
    named = found.join(index.paths, F.col("id") == F.col("file_id")).select("circle", "rel_path")
    head = index.paths.select(F.col("file_id").alias("circle"), F.col("rel_path").alias("head"))
    return named.join(head, "circle").select("rel_path", F.col("head").alias("circle"))


def entrypoints(index: Index, limit: int = 20) -> DataFrame:
    """rel_path and out_degree of the code that needs others and that no other code needs, tests left out."""
    lang = index.files.select(F.col("rel_path").alias("path"), "lang")
    fit = lambda p, l: ~F.coalesce(l.isin(*P.DATA_LANGS), F.lit(False)) & ~P.is_test(p)
    links = index.links().join(lang, F.col("src_path") == F.col("path"))
    out = links.groupBy("src_path", "lang").agg(F.count(F.lit(1)).alias("out_degree"))
    needed = links.where(fit(F.col("src_path"), F.col("lang"))).select(F.col("dst_path").alias("src_path"))
    rows = out.join(needed, "src_path", "left_anti").where(fit(F.col("src_path"), F.col("lang")))
    return rows.select(F.col("src_path").alias("rel_path"), "out_degree").orderBy(F.desc("out_degree"), P.depth(F.col("src_path")), "src_path").limit(limit)


def exported(index: Index, limit: int = 200) -> DataFrame:
    """src_path and dst_path of the links among the files with most incoming links."""
    links = index.links().select("src_path", "dst_path").distinct()
    degree = links.groupBy(F.col("dst_path").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    nodes = links.select(F.col("src_path").alias("p")).union(links.select("dst_path")).distinct().join(degree, "p", "left")
    kept = materialize(nodes.orderBy(F.desc(F.coalesce("n", F.lit(0))), "p").limit(limit).select("p"), "kept")
    return links.join(kept.select(F.col("p").alias("src_path")), "src_path", "left_semi").join(kept.select(F.col("p").alias("dst_path")), "dst_path", "left_semi")
