"""Tables that change: upserts, logs, last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.session import cut


def latest(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Incoming rows replace existing ones; of several incoming rows of a key the last by ``seq`` counts."""
    new = latest(incoming, [key], F.desc(seq)).drop(seq)
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a table that is kept as folders v0, v1, ..."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    at = of(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(of(p, "_SUCCESS")))


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v{found[-1]}") if found else None


def write_version(rows: DataFrame, path: str, number: int, keep: int = 2) -> None:
    """Writes a version, again if it was begun before, and deletes all but the last ``keep``."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in [v for v in versions(spark, path) if v <= number][:-keep]:
        fs.delete(of(f"{path}/v{v}"), True)


def sink_upsert(rows: DataFrame, path: str, key: str, seq: str, keep: int = 2) -> None:
    """Commits an upsert of rows (of a key the last by ``seq``) to a table of versions: a reader sees the version before or the
    one after, whole."""
    found = versions(rows.sparkSession, path)
    if found:
        new = upsert(rows.sparkSession.read.parquet(f"{path}/v{found[-1]}"), rows, key, seq)
    else:
        new = latest(rows, [key], F.desc(seq)).drop(seq)
    write_version(new, path, found[-1] + 1 if found else 0, keep)


def user_upsert(existing: DataFrame, incoming: DataFrame, first_is_admin: bool = True) -> DataFrame:
    """The users after logins (sub, email, name, role, status, at; one a subject), with how each came about: kept, by sub, by
    email or new.

    A login is matched by its subject, else by its e-mail, and takes the id and creation time of the user it matches, whose
    role and status stay unless the login brings its own. A new user is a pending user; with an empty table the first login
    is an active admin, if ``first_is_admin``. Of several users with one e-mail the least id is matched, and of several
    logins that match one user the last.
    """
    cols = ["id", "sub", "email", "name", "role", "status", "created_at"]
    e = existing.select(*cols)
    subs = e.groupBy("sub").agg(F.min("id").alias("by_sub")).where("sub IS NOT NULL")
    mails = e.groupBy("email").agg(F.min("id").alias("by_email")).where("email IS NOT NULL AND email <> ''")
    found = incoming.join(subs, "sub", "left").join(mails, "email", "left").withColumn("hit", F.coalesce("by_sub", "by_email"))
    how = F.when(F.col("by_sub").isNotNull(), "by sub").when(F.col("by_email").isNotNull(), "by email").otherwise("new")
    last = found.where("hit IS NOT NULL").groupBy("hit").agg(F.max_by(F.struct("sub", "email", "name", "role", "status", how.alias("how")), "at").alias("l"))
    j = e.join(last, e["id"] == last["hit"], "left")
    now = lambda c: F.when(F.col("l").isNull(), F.col(c)).otherwise(F.col(f"l.{c}")).alias(c)
    kept = lambda c: F.coalesce(F.col(f"l.{c}"), F.col(c)).alias(c)
    old = j.select("id", now("sub"), now("email"), now("name"), kept("role"), kept("status"), "created_at", F.coalesce("l.how", F.lit("kept")).alias("how"))
    new = found.where("hit IS NULL")
    role, status = F.lit("user"), F.lit("pending")
    if first_is_admin and existing.isEmpty():
        first = new.agg(F.min(F.struct("at", "sub")).alias("f")).first()["f"]
        if first is not None:
            leads = F.col("sub") == first["sub"]
            role, status = F.when(leads, "admin").otherwise(role), F.when(leads, "active").otherwise(status)
    made = new.select(F.concat(F.lit("u-"), F.col("sub")).alias("id"), "sub", "email", "name", F.coalesce("role", role).alias("role"), F.coalesce("status", status).alias("status"), F.col("at").alias("created_at"), F.lit("new").alias("how"))
    return old.unionByName(made)


def update_only(existing: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Matched rows take the new value where there is one; unmatched incoming rows are ignored."""
    new = incoming.select(key, F.col(column).alias("__new"))
    return existing.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def replay(log: DataFrame, key: str = "id", seq: str = "sequence", op: str = "op", payload: str = "payload") -> DataFrame:
    """State after a log: the payload of each key's last operation, deleted keys gone; rows without a key or sequence are skipped."""
    rows = log.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    last = rows.groupBy(key).agg(F.max_by(F.struct(op, payload), seq).alias("m"))
    return last.select(key, f"m.{op}", f"m.{payload}").where(F.col(op) != "delete")


def last_writer(rows: DataFrame, key: list[str], value: str, ts: str, seq: str) -> DataFrame:
    """Of each register the value with the greatest (ts, seq)."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(ts, seq)).alias(value), F.max(ts).alias(ts))


def numbered(rows: DataFrame, order: str, start: int = 0) -> DataFrame:
    """``rows`` with ``sequence``: start, start + 1, ... in the order of a column.

    Rows are range-partitioned, so no task sees them all; a partition's first number is the sum of the counts before it.
    """
    placed = cut(rows.repartitionByRange(order).sortWithinPartitions(order)).withColumn("m_", F.monotonically_increasing_id())
    part, at = F.shiftright("m_", 33), F.col("m_").bitwiseAND((1 << 33) - 1)
    placed = placed.select("*", part.alias("part_"), at.alias("at_")).drop("m_")
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))  # a row a partition
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("part_", before.alias("first_"))
    return placed.join(first, "part_").withColumn("sequence", F.col("first_") + F.col("at_") + start).drop("part_", "at_", "first_")


def append_log(rows: DataFrame, path: str, order: str, start: int = 0) -> None:
    """Append JSON lines, numbered from ``start`` in the order of a column and stamped; readers order by the number."""
    stamped = numbered(rows, order, start).withColumn("timestamp", F.unix_millis(F.current_timestamp()))
    stamped.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read_log(spark, path: str, schema: str) -> DataFrame:
    """Lines of a log; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
