"""Queries of mutations, logs, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import store as T
from quillgraph.registry import register
from quillgraph.session import checkpoint_dir, table
from quillgraph.sources import files, folder
from quillgraph.streaming import streams

events = lambda s, d: table(s, d, "events")


@register("upsert_by_id", "WITH i AS (SELECT user_id AS id, arg_max(event_type, event_id) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT c_custkey AS id, c_name AS v FROM customer WHERE c_custkey NOT IN (SELECT id FROM i) UNION ALL SELECT id, v FROM i")
def upsert_by_id(spark, d):
    inc = events(spark, d).where("user_id % 2 = 0").select(F.col("user_id").alias("id"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"))
    return T.upsert(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v")), inc, "id", "seq")


@register("sink_upsert", "WITH i AS (SELECT user_id AS id, arg_max(event_type, event_id) AS v FROM events GROUP BY 1) SELECT c_custkey AS id, c_name AS v FROM customer WHERE c_custkey NOT IN (SELECT id FROM i) UNION ALL SELECT id, v FROM i")
def sink_upsert(spark, d):
    """Customers, then two upserts of events, committed to a table of versions and read back."""
    path = f"{checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    rows = events(spark, d).select(F.col("user_id").alias("id"), F.col("event_type").alias("v"), F.col("event_id").alias("seq"))
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("v"), F.lit(-1).cast("long").alias("seq"))
    middle = rows.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)")).first()[0]
    for part in (first, rows.where(F.col("seq") <= middle), rows.where(F.col("seq") > middle)):
        T.sink_upsert(part, path, "id", "seq")
    return T.latest_version(spark, path)


_UPDATE = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS c_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND c_custkey % 4 = 0"


def _update(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return T.update_only(c, table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), "c_custkey", "c_name")


register("merge_insert_update_only", _UPDATE)(_update)
register("update_node", _UPDATE)(_update)
register("ner_retag", _UPDATE)(_update)


@register("delete_edge", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 10 = 3)")
def delete_edge(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return li.join(table(spark, d, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")


@register("delete_document", "SELECT count(*) AS chunks FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 <> 0)")
def delete_document(spark, d):
    """Documents go, and their chunks with them."""
    gone = table(spark, d, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(known, "l_orderkey", "left_semi").join(gone, "l_orderkey", "left_anti").agg(F.count("*").alias("chunks"))


@register("delete_collection", """WITH g AS (SELECT r_regionkey AS k FROM region WHERE r_regionkey % 2 = 0), n AS (SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT k FROM g)), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) SELECT 'collections' AS kind, count(*) AS n FROM region WHERE r_regionkey NOT IN (SELECT k FROM g) UNION ALL SELECT 'topics', count(*) FROM n UNION ALL SELECT 'nodes', count(*) FROM c
UNION ALL SELECT 'documents', count(*) FROM o UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def delete_collection(spark, d):
    """Collections go, and all that hangs on them: topics, nodes, documents and their chunks."""
    t = lambda name: table(spark, d, name)
    r = t("region").where("r_regionkey % 2 <> 0")
    n = t("nation").join(r.select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    c = t("customer").join(n.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    o = t("orders").join(c.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    li = t("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    out = None
    for kind, df in (("collections", r), ("topics", n), ("nodes", c), ("documents", o), ("chunks", li)):
        part = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def _log(spark, d):
    op = F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert")
    return events(spark, d).select(F.col("user_id").alias("id"), F.col("event_id").alias("sequence"), op.alias("op"), F.col("props").alias("payload"))


@register("wal_replay", "SELECT user_id AS id, arg_max(props, event_id) AS payload FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'")
def wal_replay(spark, d):
    return T.replay(_log(spark, d)).select("id", "payload")


@register("wal_append", "SELECT user_id AS id, row_number() OVER (ORDER BY event_id) + 99 AS sequence, true AS stamped FROM events")
def wal_append(spark, d):
    """Append to a log in the shared folder, which gives numbers and stamps, and read it back; lines that don't parse are skipped."""
    path = f"{checkpoint_dir(spark)}/wal-{uuid.uuid4().hex}"
    T.append_log(_log(spark, d).withColumnRenamed("sequence", "event"), path, "event", 100)
    spark.range(1).select(F.lit("{not json").alias("value")).write.mode("append").text(path)
    return T.read_log(spark, path, "id long, sequence long, op string, payload string, timestamp long").select("id", "sequence", (F.col("timestamp") > 0).alias("stamped"))


@register("lww_register", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def lww_register(spark, d):
    return T.last_writer(events(spark, d), ["user_id", "event_type"], "value", "ts", "event_id").select("user_id", "event_type", "value")


@register("job_progress", "SELECT user_id AS job, arg_max(event_type, event_id) AS status, max(event_id) AS done FROM events GROUP BY 1")
def job_progress(spark, d):
    return streams.job_progress(events(spark, d).select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"), F.col("event_id").alias("done")))


@register("revocation_purge", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)")
def revocation_purge(spark, d):
    e = events(spark, d).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    mid = e.agg((F.min("us") + (F.max("us") - F.min("us")) / 2).alias("now"))
    return e.join(F.broadcast(mid), F.col("us") >= F.col("now")).select("event_id")


@register("user_upsert", """WITH e AS (SELECT 'e' || c_custkey AS id, 's' || c_custkey AS sub, lower(c_name) AS email, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'admin' ELSE 'user' END AS role, 'active' AS status, c_custkey::BIGINT AS created_at FROM customer WHERE c_custkey % 3 = 0),
i AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE 's' END || c_custkey AS sub, lower(c_name) AS email, upper(c_name) AS name, CASE WHEN c_custkey % 7 = 0 THEN 'guest' END AS role, (1000000 + c_custkey)::BIGINT AS seen FROM customer WHERE c_custkey % 2 = 0),
j AS (SELECT e.*, i.sub AS s2, i.name AS n2, i.role AS r2, CASE WHEN i.sub = e.sub THEN 'by sub' WHEN i.sub IS NOT NULL THEN 'by email' ELSE 'kept' END AS how FROM e LEFT JOIN i ON i.email = e.email)
SELECT id, coalesce(s2, sub) AS sub, email, coalesce(n2, name) AS name, coalesce(r2, role) AS role, status, created_at, how FROM j
UNION ALL SELECT 'u-' || sub, sub, email, name, coalesce(role, 'user'), 'pending', seen, 'new' FROM i WHERE email NOT IN (SELECT email FROM e)""")
def user_upsert(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    e = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("e"), k.cast("string")).alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("sub"), F.lower("c_name").alias("email"), F.col("c_name").alias("name"), F.when(k % 4 == 0, "admin").otherwise("user").alias("role"), F.lit("active").alias("status"), k.cast("long").alias("created_at"))
    sub = F.concat(F.when(k % 5 == 0, "other").otherwise("s"), k.cast("string"))
    i = c.where("c_custkey % 2 = 0").select(sub.alias("sub"), F.lower("c_name").alias("email"), F.upper("c_name").alias("name"), F.when(k % 7 == 0, "guest").alias("role"), F.lit(None).cast("string").alias("status"), (F.lit(1000000) + k).cast("long").alias("at"))
    return T.user_upsert(e, i)


@register("latest_version", "SELECT user_id, max(event_id) AS version, arg_max(props, event_id) AS props FROM events GROUP BY 1")
def latest_version(spark, d):
    return T.latest(events(spark, d), ["user_id"], F.desc("event_id")).select("user_id", F.col("event_id").alias("version"), "props")


@register("ontology_update", "SELECT c_mktsegment AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer GROUP BY 1 UNION ALL SELECT 'NEWTYPE', 2")
def ontology_update(spark, d):
    """Union of type maps, incoming ones overwriting, with the next version."""
    old = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct().withColumn("version", F.lit(1))
    new = spark.createDataFrame([("BUILDING", 2), ("NEWTYPE", 2)], "name string, version int")
    return old.join(F.broadcast(new.select("name")), "name", "left_anti").unionByName(new)


@register("feed_existing_minus", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def feed_existing_minus(spark, d):
    hit = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").distinct().join(hit, "o_orderkey", "left_anti")


@register("skip_already_indexed", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def skip_already_indexed(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return files.not_indexed(p, p.where("page_id % 3 = 0")).select("page_id")


@register("hash_incremental_ingest", "SELECT page_id FROM pages WHERE page_id % 3 <> 0 AND (url, sha256(html)) NOT IN (SELECT url, sha256(html) FROM pages WHERE page_id % 3 = 0)")
def hash_incremental_ingest(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.sha2("html", 256).alias("hash"))
    return files.changed_files(p, p.where("page_id % 3 = 0")).select("page_id")


@register("drive_sync", "SELECT page_id FROM pages WHERE page_id % 2 = 1")
def drive_sync(spark, d):
    p = table(spark, d, "pages").select("page_id", F.col("page_id").cast("string").alias("file_id"), F.when(F.col("page_id") % 3 == 0, F.md5("html")).alias("md5"), F.lit("2024-01-01").alias("modified"))
    mark = F.coalesce("md5", F.md5(F.concat_ws(":", "file_id", "modified")))
    return files.drive_changes(p, p.where("page_id % 2 = 0").withColumn("mark", mark)).select("page_id")


@register("scan_folder", "SELECT 'text' AS kind, 2 AS depth, count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents)")
def scan_folder(spark, d):
    """The texts written as one file a language and source, and what the folder source lists of them."""
    path = f"{checkpoint_dir(spark)}/scan-{uuid.uuid4().hex}"
    texts = table(spark, d, "documents").select("lang", "source", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("text"))
    texts.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    return folder.scan(spark, path.removeprefix("file:")).groupBy("kind", "depth").agg(F.count("*").alias("n"))


@register("rate_limit", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit(spark, d):
    return streams.rate_windows(events(spark, d), 1, "1 hour")


def _stream(spark, d, columns):
    """The events as a file stream, from split files in the shared folder."""
    path = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events(spark, d).select(*columns).repartition(4).write.parquet(f"{path}/in")
    kinds = spark.read.parquet(f"{path}/in").schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 2).parquet(f"{path}/in"), path


@register("file_watch", "SELECT event_id, user_id FROM events")
def file_watch(spark, d):
    s, path = _stream(spark, d, ["event_id", "user_id"])
    streams.drain(s, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


@register("micro_batch_commit", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def micro_batch_commit(spark, d):
    """Two bounded batches, upserted by user; the greater event of a user wins whatever its batch."""
    s, path = _stream(spark, d, ["event_id", "user_id", "event_type"])
    streams.drain(s, f"{path}/log", f"{path}/state")
    return T.latest(spark.read.parquet(f"{path}/log"), ["user_id"], F.desc("event_id")).select("user_id", "event_type")


@register("feed_pipeline", "SELECT user_id AS id, arg_max(props, event_id) AS payload FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'purchase'")
def feed_pipeline(spark, d):
    """A log fed as a stream, then compacted to the final state."""
    s, path = _stream(spark, d, ["event_id", "user_id", "event_type", "props"])
    streams.drain(s, f"{path}/log", f"{path}/state")
    log = spark.read.parquet(f"{path}/log").select(F.col("user_id").alias("id"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("op"), F.col("props").alias("payload"))
    return T.replay(log).select("id", "payload")


@register("stream_rate_limit", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def stream_rate_limit(spark, d):
    """The windowed count as a stream without a watermark: the final state is complete."""
    s, path = _stream(spark, d, ["ts", "user_id"])
    name = f"qg_{uuid.uuid4().hex}"
    q = streams.rate_windows(s, 1, "1 hour", None).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@register("hourly_prune", "SELECT n_regionkey, s_suppkey FROM (SELECT n_regionkey, s_suppkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal >= 1000) WHERE r <= 5")
def hourly_prune(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal >= 1000").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 5").select("n_regionkey", "s_suppkey")
