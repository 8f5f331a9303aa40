"""Queries of jobs, progress and stored segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, store
from ..sources.tables import table
from .register import query

_SIX = "('header_footer', 'formula', 'author', 'reference', 'figure_text', 'algorithm')"
_JOBS = "(SELECT DISTINCT * FROM jobs)"
_SEG = "(SELECT DISTINCT * FROM segments)"
_P = "(SELECT DISTINCT * FROM progress)"


@query(f"SELECT doc_id, count(translated) AS done, count(*) AS total FROM {_SEG} WHERE kind NOT IN {_SIX} GROUP BY doc_id")
def segment_progress(spark: SparkSession, d: str) -> DataFrame:
    """A1: done and total translatable segments."""
    s = table(spark, d, "segments").distinct().where(f"kind NOT IN {_SIX}")
    return s.groupBy("doc_id").agg(F.sum(F.when(F.col("translated").isNotNull(), 1).otherwise(0)).alias("done"), F.count(F.lit(1)).alias("total"))


@query(f"SELECT doc_id, arg_max(segment_id, done) AS segment_id, max(done) AS done, arg_max(total, done) AS total, arg_max(page, done) AS page FROM {_P} GROUP BY doc_id")
def latest_progress(spark: SparkSession, d: str) -> DataFrame:
    """The furthest event of each job."""
    p = table(spark, d, "progress").distinct()
    return p.groupBy("doc_id").agg(F.max_by(F.struct("segment_id", "total", "page"), "done").alias("x"), F.max("done").alias("done")).select("doc_id", "x.segment_id", "done", "x.total", "x.page")


_BOARD = f"""l AS (SELECT doc_id, max(done) AS done, arg_max(total, done) AS total FROM {_P} GROUP BY doc_id),
b AS (SELECT j.doc_id, j.filename, j.status, l.done, l.total, CASE WHEN j.status = 'done' THEN 100.0::DOUBLE WHEN l.total > 0 AND l.done >= l.total THEN 96.0::DOUBLE WHEN l.total > 0 THEN 8 + 88.0::DOUBLE * l.done / l.total
  WHEN j.status = 'translating' THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END AS percent FROM {_JOBS} j LEFT JOIN l USING (doc_id))"""


def _board(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").distinct()
    l = table(spark, d, "progress").distinct().groupBy("doc_id").agg(F.max("done").alias("done"), F.max_by("total", "done").alias("total"))
    known = F.col("total") > 0
    pct = (
        F.when(F.col("status") == "done", 100.0).when(known & (F.col("done") >= F.col("total")), 96.0).when(known, F.lit(8) + F.lit(88.0) * F.col("done") / F.col("total"))
        .when(F.col("status") == "translating", 5.0).otherwise(2.0)
    )
    return j.join(l, "doc_id", "left").select("doc_id", "filename", "status", "done", "total", pct.alias("percent"))


@query(f"WITH {_BOARD} SELECT * FROM b")
def board_rows(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with their progress and weighted percentage: queued 2, analysing 5, translating 8 to 96, done 100."""
    return _board(spark, d)


@query(f"WITH {_BOARD} SELECT status, count(*) AS n, avg(percent) AS mean FROM b WHERE status <> 'uploaded' GROUP BY status")
def board_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean percentage of the started jobs, by status."""
    return _board(spark, d).where("status <> 'uploaded'").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("percent").alias("mean"))


@query(f"SELECT doc_id, filename, CAST(row_number() OVER (ORDER BY strptime(substr(created_at, 1, 19), '%Y-%m-%dT%H:%M:%S') DESC, doc_id) AS INT) AS place FROM {_JOBS} WHERE created_at IS NOT NULL QUALIFY place <= 100")
def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest jobs (the report's own limit)."""
    j = table(spark, d, "jobs").distinct().where("created_at IS NOT NULL").withColumn("at", F.to_timestamp(F.substring("created_at", 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
    top = j.orderBy(F.col("at").desc(), "doc_id").limit(100)
    return top.select("doc_id", "filename", F.row_number().over(Window.orderBy(F.col("at").desc(), "doc_id")).alias("place"))


@query(f"SELECT status, count(*) AS n, count(error) AS n_errors FROM {_JOBS} GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status."""
    return table(spark, d, "jobs").distinct().groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"))


@query("""WITH ids AS (SELECT doc_id AS id, min(o) AS o FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS o FROM doc_profile UNION ALL SELECT 'x' || doc_id, 0 FROM doc_profile WHERE text_form = 'scanned') GROUP BY doc_id)
SELECT i.id, j.doc_id IS NULL AS missing FROM ids i LEFT JOIN (SELECT DISTINCT doc_id FROM jobs) j ON i.id = j.doc_id""")
def requested_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Requested ids with the jobs found and the missing ones."""
    p = table(spark, d, "doc_profile")
    ids = p.select(F.col("doc_id").alias("id")).unionByName(p.where("text_form = 'scanned'").select(F.concat(F.lit("x"), "doc_id").alias("id"))).distinct()
    j = table(spark, d, "jobs").select(F.col("doc_id").alias("id"), F.lit(True).alias("found")).distinct()
    return ids.join(j, "id", "left").select("id", F.col("found").isNull().alias("missing"))


_NEW = f"SELECT doc_id, seg_id, page, kind, source, source || '!' AS translated, 'done' AS status FROM {_SEG} WHERE status = 'pending' UNION ALL SELECT doc_id, seg_id || 'n', page, kind, source, NULL, 'pending' FROM {_SEG} WHERE kind = 'algorithm'"


@query(f"""WITH new AS ({_NEW}), old AS (SELECT doc_id, seg_id, page, kind, source, translated, status, translated_bbox FROM {_SEG})
SELECT n.doc_id, n.seg_id, n.page, n.kind, n.source, n.translated, n.status, o.translated_bbox FROM new n LEFT JOIN old o USING (doc_id, seg_id)
UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id AND n.seg_id = o.seg_id)""")
def upserted_segments(spark: SparkSession, d: str) -> DataFrame:
    """K2: segments written over by key; the placed box stays."""
    cols = ["doc_id", "seg_id", "page", "kind", "source", "translated", "status"]
    s = table(spark, d, "segments").distinct()
    new = s.where("status = 'pending'").withColumn("translated", F.concat("source", F.lit("!"))).withColumn("status", F.lit("done")).select(*cols)
    new = new.unionByName(s.where("kind = 'algorithm'").withColumn("seg_id", F.concat("seg_id", F.lit("n"))).withColumn("translated", F.lit(None).cast("string")).withColumn("status", F.lit("pending")).select(*cols))
    return store.upsert(s.select(*cols, "translated_bbox"), new, ["doc_id", "seg_id"], keep=["translated_bbox"])


@query(f"""SELECT doc_id, seg_id, CASE WHEN status = 'done' AND translated_bbox IS NOT NULL THEN translated_bbox ELSE bbox END AS placed FROM {_SEG}""")
def placed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The placed box of each segment, else its own."""
    s = table(spark, d, "segments").distinct()
    return s.select("doc_id", "seg_id", F.when((F.col("status") == "done") & F.col("translated_bbox").isNotNull(), F.col("translated_bbox")).otherwise(F.col("bbox")).alias("placed"))


@query(f"SELECT doc_id, CASE WHEN status = 'translating' THEN 'error' ELSE status END AS status FROM {_JOBS}")
def recovered_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs found running after a restart end as errors."""
    return table(spark, d, "jobs").distinct().select("doc_id", F.when(F.col("status") == "translating", "error").otherwise(F.col("status")).alias("status"))


@query(f"SELECT s.doc_id, s.seg_id FROM {_SEG} s WHERE NOT EXISTS (SELECT 1 FROM {_JOBS} j WHERE j.doc_id = s.doc_id AND j.status = 'cancelled')")
def after_delete(spark: SparkSession, d: str) -> DataFrame:
    """K5: segments left when those of cancelled jobs are deleted."""
    gone = table(spark, d, "jobs").where("status = 'cancelled'").select("doc_id").distinct()
    return store.delete(table(spark, d, "segments").distinct(), gone, ["doc_id"]).select("doc_id", "seg_id")


@query(f"""SELECT doc_id, page, count(*) FILTER (kind = 'body') AS n_body, count(*) FILTER (translated IS NOT NULL) AS n_translated, string_agg(seg_id, ',' ORDER BY seg_id) AS seg_ids FROM {_SEG} GROUP BY doc_id, page""")
def page_groups(spark: SparkSession, d: str) -> DataFrame:
    """The segments of each page."""
    s = table(spark, d, "segments").distinct()
    return s.groupBy("doc_id", "page").agg(F.count(F.when(F.col("kind") == "body", 1)).alias("n_body"), F.count("translated").alias("n_translated"), F.array_join(F.array_sort(F.collect_list("seg_id")), ",").alias("seg_ids"))


@query(f"""SELECT doc_id, segment_id, done, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY done, segment_id) AS INT) AS running, date_diff('microsecond', emitted_at, arrived_at) AS delay_us FROM {_P}""")
def event_delays(spark: SparkSession, d: str) -> DataFrame:
    """Events numbered in order, with their delay."""
    p = table(spark, d, "progress").distinct()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = blocks.rank(p, ["doc_id"], F.floor(F.col("done") / 1000), ["done", "segment_id"], "running")
    return r.select("doc_id", "segment_id", "done", F.col("running").cast("int").alias("running"), (us("arrived_at") - us("emitted_at")).alias("delay_us"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events WHERE json_valid(props)""")
def decoded_events(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines decoded, malformed ones skipped."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int")).where("p IS NOT NULL")
    return e.select("event_id", F.col("p.k").alias("k"), "event_type")


@query("""WITH s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place, event_type FROM events)
SELECT event_id, event_type, place, place <= 4 AS admitted FROM s""")
def admissions(spark: SparkSession, d: str) -> DataFrame:
    """Places in the queue of each kind, and who is let in by a limit of four."""
    e = blocks.rank(table(spark, d, "events"), ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "place")
    return e.select("event_id", "event_type", "place", (F.col("place") <= 4).alias("admitted"))
