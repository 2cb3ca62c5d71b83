"""Parent-child rows to full hierarchies.

1. Leaves are peeled round by round. A peeled node hands the size of its subtree to its parent,
   so a round is one aggregation by parent and one join by id. Peeling goes on while it shrinks
   what is left by a fair part; trees that are wide and shallow are gone after a few rounds, long
   chains and everything that leads through a circle remain as the core.
2. The core gets Euler tours: every node is entered and left once, and the tours are linked lists.
   Parallel list ranking by pointer jumping gives, of every list element, the sums of the weights
   up to the list's end. The +1/-1 sum is the depth, the element at the end names the root, and
   the position sums are the entry and exit of the node. A tour that runs through a circle has no
   end: once a round finishes no element, what is still unranked is circular. The
   nodes on the circles are found by following parents often enough; what hangs below them is
   ranked again as trees of its own, so only the circles themselves have no interval.
3. The peeled layers come back in reverse order; a node's interval lies inside its parent's.

Entry and exit count back from the end of the node's tour, so they need no pass for its length.
``a`` is an ancestor of ``b`` exactly if they have the same ``tree_id``, ``a.entry < b.entry`` and
``b.exit < a.exit``; a node has ``(exit - entry - 1) / 2`` descendants.

Defined results: a parent that is null or 0 is none; an id with repeated rows is one node, and if
its rows name several parents the smallest counts; rows with a null id are left out; an empty
table gives no rows. No group of siblings, nor a tree, is ever handled by one task: siblings are
chained in hash buckets whose number follows the number of nodes.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quern.storage import Scratch, _fs, delete, shared_dir

#: Peeling ends when the inner nodes are fewer than this part of all nodes,
CORE_PART = 1 / 10
#: or when a round takes less than this part of what is left.
LEAST_SHRINK = 0.1
#: Expected siblings per chained bucket of the largest possible group.
BUCKET_ROWS = 200_000


@dataclass
class _Run:
    scratch: Scratch
    nodes: int = 0
    buckets: int = 1


def tree_nodes(df: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, parent): one row per id, parent null where there is none."""
    p = F.col(parent).cast("long")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.when(p != 0, p).alias("parent"))
    return rows.groupBy("id").agg(F.min("parent").alias("parent"))


def _counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()]), seen


#: The inner nodes of (id, parent, acc, leaf), with the sizes of the leaves below them added.
_WITHOUT_LEAVES = """
WITH kids AS (SELECT parent AS up, coalesce(sum(CASE WHEN leaf THEN acc + 1 END), 0) AS add, count_if(NOT leaf) AS inner_kids
              FROM {state} WHERE parent IS NOT NULL GROUP BY parent)
SELECT id, parent, acc + add AS acc, inner_kids = 0 AS leaf FROM {state} JOIN kids ON id = up WHERE NOT leaf
"""


def _peel(nodes: DataFrame, run: _Run) -> tuple[list[DataFrame], DataFrame]:
    """Layers of (id, parent, size), outermost first, and the core (id, parent, acc)."""
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("q_p")).agg(F.count("*").alias("q_n"))
    state = nodes.join(kids, F.col("id") == F.col("q_p"), "left").select("id", "parent", F.lit(0).cast("long").alias("acc"), F.col("q_n").isNull().alias("leaf"))
    layers, r = [], 0
    while True:
        state, seen = _counted(state, leaves=F.col("leaf"), inner=~F.col("leaf"))
        state = run.scratch.save(state, f"peel{r}")
        leaves, inner = seen.get["leaves"], seen.get["inner"]
        if r == 0:
            run.nodes = leaves + inner
            run.buckets = 1 + run.nodes // BUCKET_ROWS
        layers.append(state.where("leaf").selectExpr("id", "parent", "acc + 1 AS size"))
        rest = state.sparkSession.sql(_WITHOUT_LEAVES, state=state)
        r += 1
        if inner <= run.nodes * CORE_PART or leaves < LEAST_SHRINK * (leaves + inner):
            return layers, run.scratch.save(rest.drop("leaf"), "core")
        state = rest


def _bucket(run: _Run) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(run.buckets)).alias("q_b")


def _siblings(rows: DataFrame, run: _Run, value: str) -> DataFrame:
    """Adds to rows of (id, parent, ...) ``q_next``, the next sibling, and ``q_off``, the sum of ``value`` over the siblings before.

    Siblings are ordered by bucket and id. The windows over rows cover one bucket of a parent, the
    window over buckets covers one row for each bucket of a parent.
    """
    rows = rows.withColumn("q_b", _bucket(run))
    inner = Window.partitionBy("parent", "q_b").orderBy("id")
    before = F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if run.buckets == 1:
        return rows.select("*", F.lead("id").over(inner).alias("q_next"), before.alias("q_off")).drop("q_b")
    heads = rows.groupBy(F.col("parent").alias("q_hp"), F.col("q_b").alias("q_hb")).agg(F.min("id").alias("q_head"), F.sum(value).alias("q_sum"))
    outer = Window.partitionBy("q_hp").orderBy("q_hb")
    carried = F.coalesce(F.sum("q_sum").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("q_hp", "q_hb", F.lead("q_head").over(outer).alias("q_jump"), carried.alias("q_carry"))
    rows = rows.select("*", F.lead("id").over(inner).alias("q_lead"), before.alias("q_in"))
    rows = rows.join(heads, (F.col("parent") == F.col("q_hp")) & (F.col("q_b") == F.col("q_hb")))
    rows = rows.withColumn("q_next", F.coalesce("q_lead", "q_jump")).withColumn("q_off", F.col("q_in") + F.col("q_carry"))
    return rows.drop("q_b", "q_hp", "q_hb", "q_lead", "q_jump", "q_in", "q_carry")


def euler_tour(core: DataFrame, run: _Run) -> DataFrame:
    """The linked lists (e, side, nxt, n_side, pos, dep, tail) of the tours over (id, parent, acc).

    An element is a node and a side, 0 to enter it and 1 to leave it. Entering counts the places
    that the node's peeled subtrees will take. A list ends with leaving its root, the ``tail``.
    """
    ids = core.select(F.col("id").alias("q_pid"))
    known = core.where(F.col("parent").isNotNull()).join(ids, F.col("parent") == F.col("q_pid")).select("id", "parent").withColumn("q_one", F.lit(1).cast("long"))
    linked = _siblings(known, run, "q_one").select("id", "parent", "q_next", "q_off")
    first = linked.where(F.col("q_off") == 0).select(F.col("parent").alias("q_fp"), F.col("id").alias("q_first"))
    one = F.lit(1).cast("long")
    enter = core.join(first, F.col("id") == F.col("q_fp"), "left")
    enter = enter.select(
        F.col("id").alias("e"), F.lit(0).alias("side"), F.coalesce("q_first", "id").alias("nxt"), F.when(F.col("q_first").isNull(), 1).otherwise(0).alias("n_side"), (F.col("acc") * 2 + 1).alias("pos"), one.alias("dep")
    )
    leave = core.select("id").join(linked.select(F.col("id").alias("q_id"), "parent", "q_next"), F.col("id") == F.col("q_id"), "left")
    leave = leave.select(F.col("id").alias("e"), F.lit(1).alias("side"), F.coalesce("q_next", "parent").alias("nxt"), F.when(F.col("q_next").isNull(), 1).otherwise(0).alias("n_side"), one.alias("pos"), (-one).alias("dep"))
    return enter.unionByName(leave).withColumn("tail", F.when(F.col("nxt").isNull(), F.col("e")))


#: In SQL, because the rounds are many and each expression of the column API is a call to the JVM.
_TWO_JUMPS = """
WITH one AS (SELECT a.e, a.side, b.nxt, b.n_side, a.pos + b.pos AS pos, a.dep + b.dep AS dep, b.tail
             FROM {rows} a JOIN {rows} b ON a.nxt = b.e AND a.n_side = b.side)
SELECT * FROM {rows} WHERE nxt IS NULL
UNION ALL
SELECT a.e, a.side, b.nxt, b.n_side, a.pos + coalesce(b.pos, 0), a.dep + coalesce(b.dep, 0), coalesce(b.tail, a.tail)
FROM one a LEFT JOIN {rows} b ON a.nxt = b.e AND a.n_side = b.side
"""


def rank_lists(rows: DataFrame, run: _Run, name: str = "rank") -> DataFrame:
    """Pointer jumping: ``pos`` and ``dep`` become sums up to the list's end and ``tail`` its last element.

    A round makes two jumps, which triples the reach of every element, so lists of n elements need
    log3(n) rounds. The elements of a list have all distances up to its length, so when a round
    finishes none, every list with an end is done, and elements whose ``nxt`` is not null are on
    circular ones.
    """
    rows, seen = _counted(rows, open=F.col("nxt").isNotNull())
    rows = run.scratch.save(rows, f"{name}0")
    left, r = seen.get["open"], 0

    while left:
        new, seen = _counted(rows.sparkSession.sql(_TWO_JUMPS, rows=rows), open=F.col("nxt").isNotNull())
        r += 1
        rows = run.scratch.save(new, f"{name}{r}")
        before, left = left, seen.get["open"]
        run.scratch.drop(f"{name}{r - 1}")
        if left == before:
            break
    return rows


def _on_circles(rows: DataFrame, count: int, run: _Run) -> DataFrame:
    """(on): the ids on circles, of (id, nxt) in which every id leads into one.

    After at least as many steps as the longest way in has, every id has come to its circle, and
    every id of a circle is reached by one of them; a round doubles the steps. The ids that are
    reached become fewer as long as some way is longer than the steps so far.
    """
    reached = count + 1
    for r in range(count.bit_length() + 1):
        on, seen = _counted(rows.select(F.col("nxt").alias("on")).distinct(), n=F.lit(1))
        on = run.scratch.save(on, f"on{r}")
        if r:
            run.scratch.drop(f"on{r - 1}")
        if seen.get["n"] == reached:
            break
        reached = seen.get["n"]
        rows = run.scratch.save(rows.sparkSession.sql("SELECT a.id, b.nxt FROM {rows} a JOIN {rows} b ON a.nxt = b.id", rows=rows), f"circle{r}")
        if r:
            run.scratch.drop(f"circle{r - 1}")
    return on


def _below_circles(done: DataFrame, core: DataFrame, count: int, run: _Run) -> DataFrame:
    """``done`` with intervals and ``top`` of the ``count`` nodes that run into a circle and are not on one."""
    lost = core.join(done.where(F.col("ending") == "cycle").select(F.col("id").alias("q_id")), F.col("id") == F.col("q_id")).drop("q_id")
    lost = run.scratch.save(lost, "lost")
    on = _on_circles(lost.select("id", F.col("parent").alias("nxt")), count, run)
    off = lost.join(on, F.col("id") == F.col("on"), "left_anti").join(on, F.col("parent") == F.col("on"), "left")
    off, seen = _counted(off.select("id", F.when(F.col("on").isNull(), F.col("parent")).alias("parent"), "acc"), all=F.lit(1))
    off = run.scratch.save(off, "off")
    if not seen.get["all"]:
        return done
    own = _core_result(off, rank_lists(euler_tour(off, run), run, "below_rank"))
    own = own.select(F.col("id").alias("q_id"), F.col("top").alias("q_top"), F.col("entry").alias("q_entry"), F.col("exit").alias("q_exit"))
    rows = done.join(own, F.col("id") == F.col("q_id"), "left")
    new = {c: F.coalesce(F.col(c), F.col(f"q_{c}")).alias(c) for c in ("top", "entry", "exit")}
    return run.scratch.save(rows.select(*[new.get(c, F.col(c)) for c in done.columns]), "below_tree")


def _core_result(core: DataFrame, ranked: DataFrame) -> DataFrame:
    enters, leaves = F.col("nxt").isNull() & (F.col("side") == 0), F.col("nxt").isNull() & (F.col("side") == 1)
    node = ranked.groupBy(F.col("e").alias("q_id")).agg(
        F.max(F.when(enters, F.col("tail"))).alias("tree_id"),
        F.max(F.when(enters, -F.col("dep"))).alias("level"),
        F.max(F.when(enters, -F.col("pos"))).alias("entry"),
        F.max(F.when(leaves, -F.col("pos"))).alias("exit"),
    )
    rows = core.select("id", "parent").join(node, F.col("id") == F.col("q_id")).drop("q_id")
    missing = rows.where(F.col("id") == F.col("tree_id")).where(F.col("parent").isNotNull()).select(F.col("tree_id").alias("q_m"))
    rows = rows.join(missing, F.col("tree_id") == F.col("q_m"), "left")
    ending = F.when(F.col("tree_id").isNull(), "cycle").when(F.col("q_m").isNotNull(), "missing").otherwise("root")
    return rows.select("id", "tree_id", F.col("tree_id").alias("top"), "level", "entry", "exit", ending.alias("ending"))


#: Peeled nodes inside the intervals of their parents. Without ``top`` the parent is on a circle or not in the table.
_BELOW_PARENTS = """
WITH rows AS (SELECT b.*, u.id IS NULL AS lost, u.tree_id, u.top, u.level, u.ending,
                     CASE WHEN u.top IS NULL THEN -2 * b.size ELSE u.entry + 1 + 2 * b.q_off END AS entry
              FROM {below} b LEFT JOIN {up} u ON b.parent = u.id WHERE b.q_layer = {layer})
SELECT id, parent, CASE WHEN lost THEN id ELSE tree_id END AS tree_id, coalesce(top, id) AS top,
       CASE WHEN lost THEN 0L ELSE level + 1 END AS level, entry, entry + 2 * size - 1 AS exit, size,
       CASE WHEN lost THEN 'missing' ELSE ending END AS ending
FROM rows
"""


def build_trees(df: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, parent, tree_id, top, level, entry, exit, size, ending) of every id.

    ``ending``: 'root' if following the parents reaches a node without one, 'missing' if it
    reaches an id that is not in the table, 'cycle' if it runs into a circle. ``tree_id`` is the
    topmost node and ``level`` the steps to it; on the way into a circle both are null. ``top`` is
    the topmost node whose tour entry and exit belong to: ``tree_id``, or on the way into a circle
    the last node before it. ``size`` is the number of nodes of the subtree. On a circle ``top``,
    entry, exit and size are null.
    """
    run = _Run(Scratch(df.sparkSession, "hierarchy"))
    nodes = tree_nodes(df, key, parent)
    layers, core = _peel(nodes, run)
    ranked = rank_lists(euler_tour(core, run), run)
    top = core.select(F.col("id").alias("q_id"), "parent").join(_core_result(core, ranked), F.col("id") == F.col("q_id")).drop("q_id")
    top, seen = _counted(top, circular=F.col("ending") == "cycle")
    done = run.scratch.save(top, "core_tree")
    if seen.get["circular"]:
        done = _below_circles(done, core, seen.get["circular"], run)
    done = done.withColumn("size", ((F.col("exit") - F.col("entry") + 1) / 2).cast("long"))
    columns = ["id", "parent", "tree_id", "top", "level", "entry", "exit", "size", "ending"]
    done = run.scratch.save(done.select(*columns), "tree/whole")
    found = ["tree/whole"]
    peeled = None
    for r, layer in enumerate(layers):
        rows = layer.withColumn("q_layer", F.lit(r))
        peeled = rows if peeled is None else peeled.unionByName(rows)
    single = peeled.where(F.col("parent").isNull()).select("id", "parent", F.col("id").alias("tree_id"), F.col("id").alias("top"), F.lit(0).cast("long").alias("level"), (-2 * F.col("size")).alias("entry"), F.lit(-1).cast("long").alias("exit"), "size", F.lit("root").alias("ending"), "q_layer")
    for name, some in (("tree/tops", F.col("q_layer") > 0), ("tree/lone", F.col("q_layer") == 0)):
        run.scratch.save(single.where(some).select(*columns), name)
    found.append("tree/tops")
    below = _siblings(peeled.where(F.col("parent").isNotNull()), run, "size").select("id", "parent", "size", "q_off", "q_layer")
    below = run.scratch.save(below, "below")
    for r in reversed(range(len(layers))):
        up = run.scratch.read(found, done)
        rows = up.sparkSession.sql(_BELOW_PARENTS, below=below, up=up, layer=r)
        run.scratch.save(rows.select(*columns), f"tree/layer{r}")
        found.append(f"tree/layer{r}")
    found.append("tree/lone")
    for r in range(len(layers)):
        run.scratch.drop(f"peel{r}")
    return run.scratch.read(found, done)


def kept_trees(df: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """``build_trees`` of a table of files, kept in the shared folder until one of the files changes.

    The table is named by the paths, lengths and times of the files it was built from, and appears
    under its name by one rename, so a build that fails leaves nothing and two builds agree.
    """
    spark = df.sparkSession
    marks = []
    for f in sorted(df.inputFiles()):
        fs, p = _fs(spark, f)
        status = fs.getFileStatus(p)
        marks.append((f, status.getLen(), status.getModificationTime(), key, parent))
    path = f"{shared_dir(spark)}/trees-{hashlib.sha256(repr(marks).encode()).hexdigest()[:32]}"
    fs, final = _fs(spark, path)
    if not fs.exists(final):
        tmp = f"{path}.{uuid.uuid4().hex}"
        build_trees(df, key, parent).write.parquet(tmp)
        if fs.exists(final) or not fs.rename(_fs(spark, tmp)[1], final):
            delete(spark, tmp)
    return spark.read.parquet(path)


def stored_fields(tree: DataFrame) -> DataFrame:
    """(id, root_id, depth, orphan, ending): what the thread store has to hold.

    Only trees that end at a root keep their root and depth; every other node is its own root at
    depth 0 and an orphan.
    """
    good = F.col("ending") == "root"
    return tree.select("id", F.when(good, F.col("tree_id")).otherwise(F.col("id")).alias("root_id"), F.when(good, F.col("level")).otherwise(0).cast("int").alias("depth"), F.when(good, 0).otherwise(1).cast("int").alias("orphan"), "ending")


def ancestors_of(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, ancestor, level) for a stated set of ids (column ``id``), by interval containment."""
    want = tree.join(ids.select(F.col("id").alias("q_want")).distinct(), F.col("id") == F.col("q_want"), "left_semi")
    b = want.select("id", F.col("top").alias("q_t"), F.col("entry").alias("q_in"), F.col("exit").alias("q_out"))
    a = tree.select(F.col("id").alias("ancestor"), "top", "level", "entry", "exit")
    return b.join(a, (F.col("q_t") == F.col("top")) & (F.col("entry") < F.col("q_in")) & (F.col("q_out") < F.col("exit"))).select("id", "ancestor", "level")


def descendants_of(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, descendant, level) for a stated set of ids (column ``id``), by interval containment."""
    want = tree.join(ids.select(F.col("id").alias("q_want")).distinct(), F.col("id") == F.col("q_want"), "left_semi")
    a = want.select("id", F.col("top").alias("q_t"), F.col("entry").alias("q_in"), F.col("exit").alias("q_out"))
    b = tree.select(F.col("id").alias("descendant"), "top", "level", "entry", "exit")
    return a.join(b, (F.col("q_t") == F.col("top")) & (F.col("entry") > F.col("q_in")) & (F.col("exit") < F.col("q_out"))).select("id", "descendant", "level")


def paths(tree: DataFrame) -> DataFrame:
    """(id, path): the ids from ``top`` down to the node; nodes on a circle have none.

    Chains of ancestors double in length each round, so a tree of depth d takes log2(d) rounds.
    """
    scratch = Scratch(tree.sparkSession, "paths")
    top = F.col("id") == F.col("top")
    rows = tree.where(F.col("top").isNotNull()).select("id", F.when(~top, F.col("parent")).alias("nxt"), F.array("id").alias("path"))
    r = 0
    while True:
        rows, seen = _counted(rows, open=F.col("nxt").isNotNull())
        rows = scratch.save(rows, f"r{r}")
        if r:
            scratch.drop(f"r{r - 1}")
        if not seen.get["open"]:
            return rows.select("id", "path")
        ahead = rows.select(F.col("id").alias("q_id"), F.col("nxt").alias("q_nxt"), F.col("path").alias("q_path"))
        moved = rows.where(F.col("nxt").isNotNull()).join(ahead, F.col("nxt") == F.col("q_id")).select("id", F.col("q_nxt").alias("nxt"), F.concat("q_path", "path").alias("path"))
        rows = rows.where(F.col("nxt").isNull()).unionByName(moved)
        r += 1
