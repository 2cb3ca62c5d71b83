"""Queries of the general data operators: references, increments, hierarchies, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy, incremental, references, skew
from quern.storage import Scratch
from quern.tables import table

CONTENT = ["type", "time", "title", "text", "parent", "dead", "deleted"]


def _ledger(item: DataFrame, pending: DataFrame) -> DataFrame:
    """The ledger of the items, kept as a table, and then the pending rows' references as a batch of changes."""
    stored = references.apply_deltas(None, [references.existence_deltas(item, "id"), references.reference_deltas(item, "parent")])
    stored = Scratch(item.sparkSession, "ledger").save(stored, "items")
    return references.apply_deltas(stored, [references.reference_deltas(pending, "parent")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    item, pending = table(spark, d, "item", "id", "parent"), table(spark, d, "pending", "id", "parent")
    return references.orphan_records(_ledger(item, pending), {"item": item, "pending": pending})


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records and missing keys per table and month; rows without a time have month null."""
    item, pending = table(spark, d, "item", "id", "parent", "ts"), table(spark, d, "pending", "id", "parent", "ts")
    rows = references.orphan_records(_ledger(item, pending), {"item": item, "pending": pending}, keep=["parent", "ts"])
    month = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM")
    return rows.groupBy("src", month.alias("month")).agg(F.countDistinct("id").alias("n_records"), F.countDistinct("parent").alias("n_missing"))


def p2_after_feed(spark: SparkSession, d: str) -> DataFrame:
    """Missing keys and their references after the feed's changes are applied to the kept ledger.

    The latest delivery of an id inserts it, deletes it or changes its parent.
    """
    item, pending = table(spark, d, "item", "id", "parent"), table(spark, d, "pending", "id", "parent")
    feed = table(spark, d, "hnitem", "id", "parent", "deleted", "fetched_at", "seq")
    latest = feed.groupBy("id").agg(F.max_by(F.struct("parent", "deleted"), F.struct("fetched_at", "seq")).alias("r")).select("id", "r.*")
    after = references.apply_deltas(_ledger(item, pending), references.change_deltas(item, latest))
    return after.join(references.orphan_keys(after), "ref_key", "left_semi").select("ref_key", "refs")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "hnitem", "seq", "shard", "id", "fetched_at", *CONTENT)
    runs = table(spark, d, "run_log", "id", "shard", "ended_at", "head_pos", "status")
    source = incremental.latest_version(feed, ["shard", "id"], ["fetched_at", "seq"], CONTENT)
    target = incremental.VersionedTarget(spark, Scratch(spark, "target").root, ["shard", "id"])
    target.publish(incremental.published_at_last_run(feed, runs, CONTENT))
    return target.pending(source).select("shard", "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "item", "id", "parent", "root_id", "depth", "orphan")
    right = hierarchy.stored_fields(hierarchy.build_trees(item))
    held = item.select(F.col("id").alias("q_id"), F.struct("root_id", "depth", "orphan").alias("q_held")).where(F.col("q_id").isNotNull())
    held = held.groupBy("q_id").agg(F.min("q_held").alias("q_low"), F.max("q_held").alias("q_high"))
    same = None
    for side in ("q_low", "q_high"):
        for c in ("root_id", "depth", "orphan"):
            one = F.col(side)[c].eqNullSafe(F.col(c))
            same = one if same is None else same & one
    return right.join(held, F.col("id") == F.col("q_id")).where(~same).select("id", "root_id", "depth", "ending")


def p4_tree(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and number of descendants of every id; on a circle, and for the root of a way into one, null."""
    t = hierarchy.build_trees(table(spark, d, "item", "id", "parent"))
    return t.select("id", "tree_id", "level", (F.col("size") - 1).alias("n_descendants"), "ending")


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Of every id below one with an interval: whether its own lies inside, and is as long as its subtree."""
    t = hierarchy.build_trees(table(spark, d, "item", "id", "parent"))
    up = t.where(F.col("entry").isNotNull()).select(F.col("id").alias("q_id"), F.col("top").alias("q_top"), F.col("entry").alias("q_in"), F.col("exit").alias("q_out"))
    rows = t.join(up, F.col("parent") == F.col("q_id"))
    inside = (F.col("top") == F.col("q_top")) & (F.col("q_in") < F.col("entry")) & (F.col("exit") < F.col("q_out"))
    return rows.select("id", (inside & (F.col("exit") - F.col("entry") + 1 == 2 * F.col("size"))).alias("inside"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every id that ends at a root or at a missing id, as text."""
    t = hierarchy.build_trees(table(spark, d, "item", "id", "parent"))
    return hierarchy.paths(t.where(F.col("tree_id").isNotNull())).select("id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    item = table(spark, d, "item", "root_id")
    plan = skew.plan_loads(item, "root_id")
    per = skew.aggregate_by_key(item, "root_id", [("root_id", "count", "n_rows")], plan)
    return per.where(F.col("n_rows") * 50 >= plan.total).select("root_id")


def p6_threads(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last time and deepest depth of every thread."""
    item = table(spark, d, "item", "root_id", "ts", "depth")
    return skew.aggregate_by_key(item, "root_id", [("root_id", "count", "n_rows"), ("ts", "min", "first_ts"), ("ts", "max", "last_ts"), ("depth", "max", "max_depth")])


def p6_thread_span(spark: SparkSession, d: str) -> DataFrame:
    """Of every thread whose root row is there: its rows, and the longest time from the root's row to one of them."""
    item = table(spark, d, "item", "id", "root_id", "ts")
    plan = skew.plan_loads(item, "root_id")
    roots = item.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("q_root")).agg(F.min("ts").alias("q_start"))
    rows = skew.fragment_replicate_join(item.where(F.col("root_id").isNotNull()).select("root_id", "ts"), roots, "root_id", "q_root", plan)
    rows = rows.select("root_id", (F.col("ts") - F.col("q_start")).alias("lag"))
    return rows.groupBy("root_id").agg(F.count("*").alias("n_rows"), F.max("lag").alias("max_lag"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_after_feed, p3_found, p4_found, p4_tree, p4_intervals, p4_paths, p6_found, p6_threads, p6_thread_span)}

_ORPHANS = """
WITH refs AS (SELECT 'item' AS src, id, parent, ts FROM item UNION ALL SELECT 'pending', id, parent, ts FROM pending),
lost AS (SELECT DISTINCT src, id, parent, ts FROM refs r WHERE parent IS NOT NULL AND parent <> 0
         AND NOT EXISTS (SELECT 1 FROM item i WHERE i.id = r.parent))
"""

_TREE = """
WITH RECURSIVE n AS (SELECT id, min(nullif(parent, 0)) AS parent FROM item WHERE id IS NOT NULL GROUP BY id),
walk AS (
  SELECT n.id, n.id AS tree_id, 0::BIGINT AS level, CASE WHEN n.parent IS NULL THEN 'root' ELSE 'missing' END AS ending
  FROM n WHERE n.parent IS NULL OR n.parent NOT IN (SELECT id FROM n)
  UNION ALL
  SELECT n.id, w.tree_id, w.level + 1, w.ending FROM n JOIN walk w ON n.parent = w.id),
tree AS (SELECT n.id, n.parent, w.tree_id, w.level, coalesce(w.ending, 'cycle') AS ending FROM n LEFT JOIN walk w ON n.id = w.id)
"""

# every id with all ids above it; UNION keeps pairs once, so it ends on circles
_UP = """, up AS (SELECT id, parent AS above FROM n WHERE parent IN (SELECT id FROM n)
  UNION SELECT u.id, n.parent FROM up u JOIN n ON u.above = n.id WHERE n.parent IN (SELECT id FROM n))
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT DISTINCT src, id FROM lost",
    "p2_report": _ORPHANS + "SELECT src, strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, count(DISTINCT id) AS n_records, count(DISTINCT parent) AS n_missing FROM lost GROUP BY 1, 2",
    "p2_after_feed": """
WITH f AS (SELECT id, parent, coalesce(deleted, false) AS gone FROM hnitem WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, seq DESC) = 1),
now AS (SELECT i.id, CASE WHEN f.id IS NULL THEN i.parent ELSE f.parent END AS parent FROM item i LEFT JOIN f ON i.id = f.id WHERE NOT coalesce(f.gone, false)
  UNION ALL SELECT id, parent FROM f WHERE NOT gone AND id NOT IN (SELECT id FROM item WHERE id IS NOT NULL)),
refs AS (SELECT parent FROM now UNION ALL SELECT parent FROM pending)
SELECT parent AS ref_key, count(*) AS refs FROM refs WHERE parent IS NOT NULL AND parent <> 0 AND parent NOT IN (SELECT id FROM now WHERE id IS NOT NULL) GROUP BY parent""",
    "p3_found": """
WITH good AS (SELECT shard, max(id) AS rid FROM run_log WHERE status = 'ok' GROUP BY shard),
run AS (SELECT DISTINCT r.shard, r.head_pos, r.ended_at FROM run_log r JOIN good g ON r.shard = g.shard AND r.id = g.rid AND r.status = 'ok'),
now AS (SELECT * FROM hnitem QUALIFY row_number() OVER (PARTITION BY shard, id ORDER BY fetched_at DESC, seq DESC) = 1),
old AS (SELECT h.* FROM hnitem h JOIN run r ON h.shard = r.shard AND h.fetched_at <= r.ended_at
        QUALIFY row_number() OVER (PARTITION BY h.shard, h.id ORDER BY h.fetched_at DESC, h.seq DESC) = 1)
SELECT n.shard, n.id FROM now n LEFT JOIN run r ON n.shard = r.shard LEFT JOIN old o ON n.shard = o.shard AND n.id = o.id
WHERE n.id > r.head_pos OR o.id IS NULL OR n.type IS DISTINCT FROM o.type OR n.time IS DISTINCT FROM o.time
   OR n.title IS DISTINCT FROM o.title OR n.text IS DISTINCT FROM o.text OR n.parent IS DISTINCT FROM o.parent
   OR n.dead IS DISTINCT FROM o.dead OR n.deleted IS DISTINCT FROM o.deleted""",
    "p4_found": _TREE + """, want AS (SELECT id, CASE WHEN ending = 'root' THEN tree_id ELSE id END AS root_id,
  CASE WHEN ending = 'root' THEN level ELSE 0 END::INTEGER AS depth, CASE WHEN ending = 'root' THEN 0 ELSE 1 END AS orphan, ending FROM tree)
SELECT DISTINCT w.id, w.root_id, w.depth, w.ending FROM item i JOIN want w ON i.id = w.id
WHERE i.root_id IS DISTINCT FROM w.root_id OR i.depth IS DISTINCT FROM w.depth OR i.orphan IS DISTINCT FROM w.orphan""",
    "p4_tree": _TREE + _UP + """
, n_below AS (SELECT above, count(*) AS n FROM up GROUP BY above), circle AS (SELECT id FROM up WHERE id = above)
SELECT t.id, t.tree_id, t.level, CASE WHEN t.id NOT IN (SELECT id FROM circle) THEN coalesce(b.n, 0) END AS n_descendants, t.ending
FROM tree t LEFT JOIN n_below b ON t.id = b.above""",
    "p4_intervals": _TREE + _UP + """
, circle AS (SELECT id FROM up WHERE id = above)
SELECT id, true AS inside FROM n WHERE parent IN (SELECT id FROM n) AND parent NOT IN (SELECT id FROM circle)""",
    "p4_paths": """
WITH RECURSIVE n AS (SELECT id, min(nullif(parent, 0)) AS parent FROM item WHERE id IS NOT NULL GROUP BY id),
walk AS (SELECT n.id, n.id::VARCHAR AS path FROM n WHERE n.parent IS NULL OR n.parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, w.path || '/' || n.id::VARCHAR FROM n JOIN walk w ON n.parent = w.id)
SELECT id, path FROM walk""",
    "p6_found": "SELECT root_id FROM item WHERE root_id IS NOT NULL GROUP BY root_id HAVING count(*) * 50 >= (SELECT count(*) FROM item)",
    "p6_threads": "SELECT root_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, max(depth) AS max_depth FROM item WHERE root_id IS NOT NULL GROUP BY root_id",
    "p6_thread_span": """WITH roots AS (SELECT id, min(ts) AS start FROM item WHERE id IS NOT NULL GROUP BY id)
SELECT i.root_id, count(*) AS n_rows, max(i.ts - r.start) AS max_lag FROM item i JOIN roots r ON i.root_id = r.id GROUP BY i.root_id""",
}
