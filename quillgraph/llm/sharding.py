"""Sharding by extendible hashing.

Every row has a 56-bit hash. The directory starts with one bucket; a bucket over the byte limit splits on its next hash
bit, the others stay. Splits are decided on sums per hash prefix, ``STEP`` bits at a time: one partial aggregation makes
the cells of the next ``STEP`` bits, and the sums of all shorter prefixes come from those few cells, so the documents are
read once a ``STEP``, not once a bit. Only rows of cells that are still over the limit take part in the next step.

Rows with the same hash (repeated rows) can't be parted by bits: when they alone exceed the limit, the bucket at the full
depth is cut into consecutive slices of whole rows. A single row over the limit is a shard of its own and is marked
``oversized``. Nothing grows on the driver: the directory is a table and is joined, and Spark broadcasts it only if it
is under the session's broadcast threshold.

Defined cases: a null or empty text weighs 0 bytes; a null key has a hash of its own; repeated rows go to the same bucket
until that is full; an empty table has no shards; columns named as an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut

BITS, STEP = 56, 8
#: Bytes of a shard in production.
MAX_BYTES = 16 << 20


def hash_bits(key: Column, salt: Column) -> Column:
    """56 bits from the key and what tells rows with one key apart."""
    return F.shiftrightunsigned(F.xxhash64(key, salt), 64 - BITS)


def _leaves(cells: DataFrame, done: int, limit: int) -> DataFrame:
    """Cells of ``done + STEP`` bits with the depth at which a prefix first fits, null if none does.

    ``cells``: base (prefix of ``done`` bits), cell (of ``done + STEP``), bytes. Each level is a sum over the 256 cells
    of a base, which lie together after the one exchange here.
    """
    deepest = done + STEP
    out, depth = cells.repartition("base"), F.lit(None).cast("int")
    for d in range(done + 1 if done else 0, deepest + 1):
        prefix = F.shiftright("cell", deepest - d)
        out = out.withColumn(f"s{d}", F.sum("bytes").over(Window.partitionBy("base", prefix)))
        depth = F.coalesce(depth, F.when(F.col(f"s{d}") <= limit, F.lit(d)))
    return out.select("base", "cell", depth.alias("depth"))


def assign(docs: DataFrame, limit: int = MAX_BYTES, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, shard (the prefix's bits, with ``.k`` for slice k), depth, oversized of every row.

    ``carry``: columns of ``docs`` to keep beside them; without any, no text is shuffled.
    """
    carried = [f"`{c}`" for c in carry]
    t = F.col(f"`{text}`")
    rows = cut(
        docs.select(
            F.col(f"`{key}`").alias("doc_id"),
            *carried,
            F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"),
            hash_bits(F.col(f"`{key}`"), t).alias("h"),
        )
    )
    open_rows, done, parts = rows, 0, []
    while done < BITS:
        deepest = done + STEP
        base, cell = F.shiftright("h", BITS - done) if done else F.lit(0).cast("long"), F.shiftright("h", BITS - deepest)
        cells = open_rows.groupBy(base.alias("base"), cell.alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        found = cut(_leaves(cells, done, limit))
        at = open_rows.withColumn("cell", cell).join(found.select("cell", "depth"), "cell")
        parts.append(at.where("depth IS NOT NULL").select("doc_id", *carried, "n_bytes", "h", "depth"))
        if found.where("depth IS NULL").limit(1).count() == 0:
            open_rows = None
            break
        open_rows = at.where("depth IS NULL").select("doc_id", *carried, "n_bytes", "h")
        done = deepest
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bits = F.lpad(F.bin(F.expr(f"shiftright(h, {BITS} - depth)")), F.col("depth"), "0")
    out = out.select("doc_id", *carried, "n_bytes", F.when(F.col("depth") == 0, F.lit("")).otherwise(bits).alias("shard"), "depth")
    if open_rows is not None:
        out = out.unionByName(_slices(open_rows, limit, carried))
    return out.withColumn("oversized", F.col("n_bytes") > limit)


def _slices(same: DataFrame, limit: int, carried: list[str]) -> DataFrame:
    """Rows that share all bits, in slices of whole rows.

    A slice holds floor(limit / largest size) of them, at least one; they are repeated rows, so of one size. A row's number
    comes from a random deal to 1024 sub-groups and the sub-groups' counts, so that no task gathers the whole group.
    """
    dealt = cut(same.withColumn("g", (F.rand(7) * 1024).cast("int")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("n_bytes").alias("m"))
    counts = counts.select("h", "g", before.alias("b"), F.max("m").over(Window.partitionBy("h")).alias("m"))
    at = F.col("b") + F.row_number().over(Window.partitionBy("h", "g").orderBy("doc_id")) - 1
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("m", F.lit(1))), F.lit(1))
    shard = F.concat_ws(".", F.lpad(F.bin("h"), BITS, "0"), F.floor(F.col("at") / each).cast("string"))
    return (
        dealt.join(counts, ["h", "g"]).withColumn("at", at)
        .select("doc_id", *carried, "n_bytes", shard.alias("shard"), F.lit(BITS).alias("depth"))
    )


def write_shards(docs: DataFrame, path: str, limit: int = MAX_BYTES) -> None:
    """Write each shard as its own Parquet folder ``shard=<bits>``; a task writes whole shards, streamed by sort."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    at = assign(docs, limit, carry=rest).drop("n_bytes", "depth", "oversized")
    at.repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
