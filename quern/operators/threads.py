"""Search hits regrouped by discussion thread.

Hits are joined with the items' trees, grouped by root and scored by log-sum-exp of their
similarities; hits without an item drop out, threads whose root row is missing keep an empty title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import short_date
from quern.operators import hierarchy

TAU = 0.1


def similarity(d2: Column, tau: float = TAU) -> Column:
    return F.exp(-d2 / tau)


def thread_score(sims: Column, tau: float = TAU) -> Column:
    """tau * ln(sum(exp(sim / tau))) as an aggregate; similarities are at most 1, so the shift by 1 keeps it finite."""
    return 1 + tau * F.ln(F.sum(F.exp((sims - 1) / tau)))


def hits_by_thread(hits: DataFrame, trees: DataFrame, tau: float = TAU) -> DataFrame:
    """(qid, root_id, score, n_hits, hits): ``hits`` are "id:depth" in thread order, without the root's own.

    ``hits``: (qid, vec_id, d2) with vec_id an item; ``trees``: ``hierarchy.stored_fields``. A list
    is at most as long as the number of hits asked for per query.
    """
    t = trees.select(F.col("id").alias("q_id"), "root_id", "depth")
    rows = hits.join(t, F.col("vec_id") == F.col("q_id"))
    inner = F.when(F.col("vec_id") != F.col("root_id"), F.struct("depth", "vec_id"))
    out = rows.groupBy("qid", "root_id").agg(F.round(thread_score(similarity(F.col("d2"), tau), tau), 9).alias("score"), F.count("*").alias("n_hits"), F.sort_array(F.collect_list(inner)).alias("q_hits"))
    text = F.transform("q_hits", lambda h: F.concat(h["vec_id"].cast("string"), F.lit(":"), h["depth"].cast("string")))
    return out.select("qid", "root_id", "score", "n_hits", F.array_join(text, " ").alias("hits"))


def ordered(threads: DataFrame) -> DataFrame:
    """Adds ``pos``: best score first, ties by the root id as text."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("root_id").cast("string"))
    return threads.withColumn("pos", F.row_number().over(w))


def with_roots(threads: DataFrame, items: DataFrame) -> DataFrame:
    """Adds title and date of the root; '' where the root is not in the table or has none."""
    roots = items.groupBy(F.col("id").alias("q_root")).agg(F.min("title").alias("title"), F.min("ts").alias("root_ts"))
    out = threads.join(roots, F.col("root_id") == F.col("q_root"), "left").drop("q_root")
    return out.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("date", F.coalesce(short_date(F.col("root_ts")), F.lit("")))


def by_day(threads: DataFrame, newest: bool = True) -> DataFrame:
    """Adds ``day_pos``: by day of the root, undated last either way, equal days in order of relevance."""
    day = F.to_date(F.when(F.col("root_ts") > 0, F.timestamp_seconds("root_ts")))
    first = day.desc_nulls_last() if newest else day.asc_nulls_last()
    return threads.withColumn("day_pos", F.row_number().over(Window.partitionBy("qid").orderBy(first, "pos")))


def page(threads: DataFrame, number: int, size: int = 10, pos: str = "pos") -> DataFrame:
    """Page ``number`` (from 0) of every query's threads, the last page where there are fewer."""
    n = F.count("*").over(Window.partitionBy("qid"))
    last = F.greatest(F.lit(1), F.ceil(n / size)) - 1
    return threads.withColumn("q_page", F.least(F.lit(max(0, number)), last)).where((F.col(pos) > F.col("q_page") * size) & (F.col(pos) <= (F.col("q_page") + 1) * size)).drop("q_page")


def resolve_pending(trees: DataFrame, pending: DataFrame) -> DataFrame:
    """(id, state, root_id, depth, orphan) of the pending ids that are not among the items yet.

    ``trees``: the items' right tree fields, as ``hierarchy.stored_fields`` gives them; they are
    read, not derived again, so an append costs what is pending.

    Pending rows form trees among themselves; the top of each either has no parent, or hangs on an
    item (then all of it is 'appended', below an orphan as orphans), or still waits ('pending').
    """
    new = pending.join(trees.select(F.col("id").alias("q_known")), F.col("id") == F.col("q_known"), "left_anti")
    t = hierarchy.build_trees(new)
    up = t.select(F.col("id").alias("q_top"), F.col("parent").alias("q_parent"))
    have = trees.select(F.col("id").alias("q_item"), F.col("root_id").alias("q_root"), F.col("depth").alias("q_depth"), F.col("orphan").alias("q_orphan"))
    rows = t.join(up, F.col("tree_id") == F.col("q_top"), "left").join(have, F.col("q_parent") == F.col("q_item"), "left")
    free, hung = F.col("ending") == "root", F.col("q_item").isNotNull()
    state = F.when(free | hung, "appended").otherwise("pending")
    good = hung & (F.col("q_orphan") == 0)
    root = F.when(free, F.col("tree_id")).when(good, F.col("q_root")).when(hung, F.col("id"))
    depth = F.when(free, F.col("level")).when(good, F.col("q_depth") + F.col("level") + 1).when(hung, 0)
    return rows.select("id", state.alias("state"), root.alias("root_id"), depth.cast("int").alias("depth"), F.when(free | good, 0).when(hung, 1).alias("orphan"))
