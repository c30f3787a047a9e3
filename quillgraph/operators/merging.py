"""Ordered merges of rows into a collection: what was merged, inserted and in conflict, and the rows that come out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.operators.build import EDGE_FIELDS, NODE_FIELDS, prune_dangling
from quillgraph.operators.store import latest_version, numbered, versions, write_version

STRATEGIES = ("keep_first", "keep_last", "field_overwrite")
# The fields that are compared for conflicts.
NODE_CONFLICTS = ("label", "description", "confidence", "aliases", "ontology_class", "display_label")
EDGE_CONFLICTS = ("predicate", "context", "weight", "time", "location", "display_label")


def merge_row(old: dict, new: dict, strategy: str, fields: dict[str, tuple]) -> dict:
    """``new`` merged into ``old``; the id and the fields that no rule names stay those of ``old``, or with keep_last all but the id
    become those of ``new``."""
    if strategy == "keep_first":
        return old
    if strategy == "keep_last":
        return {**new, "id": old["id"]}
    out = dict(old)
    for rule, names in fields.items():
        for f in names:
            if f not in old:
                continue
            a, b = old[f], new[f]
            if rule == "fills":
                out[f] = a if a not in (None, "") else b if b is not None else a
            elif a is None or b is None:
                out[f] = b if a is None else a
            elif rule == "joined":
                out[f] = f"{a} | {b}"
            elif rule == "unions":
                out[f] = list(dict.fromkeys([*a, *b]))
            elif rule == "means":
                out[f] = (a + b) / 2
            else:
                out[f] = list({**dict(b), **dict(a)}.items())
    return out


def _folder(strategy: str, fields: dict[str, tuple], compared: tuple[str, ...], names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # the collection's row of the key at hand, as merged so far
        counts = [0, 0]
        out: list[dict] = []

        def end() -> None:
            nonlocal held
            if held is not None:
                out.append({**held, "outcome": "merged" if counts[0] else "kept", "n_merged": counts[0], "n_conflicted": counts[1]})
            held = None

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for b in batches:
            for row in b.to_pylist():
                incoming, row = row["side_"], {k: row[k] for k in names}
                key = row["dedup_key"]
                if held is not None and (key is None or held["dedup_key"] != key or not incoming):
                    if not incoming and held["dedup_key"] == key and key is not None:  # a second row of the collection under the key
                        out.append({**row, "outcome": "kept", "n_merged": 0, "n_conflicted": 0})
                        continue
                    end()
                if not incoming:
                    held, counts = row, [0, 0]
                elif held is None:
                    out.append({**row, "outcome": "inserted", "n_merged": 0, "n_conflicted": 0})
                else:
                    counts[0] += 1
                    counts[1] += any(held[f] != row[f] for f in compared if f in row)
                    held = merge_row(held, row, strategy, fields)
            if len(out) >= 5000:
                yield pack()
                out = []
        end()
        yield pack()

    return run


def merge_into(existing: DataFrame, incoming: DataFrame, strategy: str = "field_overwrite", edges: bool = False, seq: str = "seq") -> DataFrame:
    """The collection after incoming rows in the order of ``seq``: the columns of ``existing``, outcome (kept, merged or inserted),
    n_merged and n_conflicted of each row.

    A row whose ``dedup_key`` the collection holds is merged into what the rows before it made of that row, and is in
    conflict if a compared field differs from it; others are inserted, each for itself. Of several rows of the collection
    under one key the first by id is merged into. Rows are dealt by key and read as sorted streams: a task holds one merged
    row, however many come. The fold of one key is sequential by its definition.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    names = existing.columns
    fields = {rule: tuple(f for f in group if f in names) for rule, group in (EDGE_FIELDS if edges else NODE_FIELDS).items()}
    side = lambda df, k, order: df.select(*names, F.lit(k).alias("side_"), order.alias("at_"))
    rows = side(existing, False, F.lit(None).cast(incoming.schema[seq].dataType)).unionByName(side(incoming, True, F.col(seq)))
    # rows without a key meet nothing and are spread by id
    dealt = rows.repartition(F.coalesce("dedup_key", F.concat(F.lit("id "), F.col("id").cast("string")))).sortWithinPartitions("dedup_key", "side_", "at_", "id").drop("at_")
    out = T.StructType([*existing.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("n_merged", T.LongType()), T.StructField("n_conflicted", T.LongType())])
    run = _folder(strategy, fields, EDGE_CONFLICTS if edges else NODE_CONFLICTS, names, to_arrow_schema(out))
    return dealt.mapInArrow(run, out)


def report(merged: DataFrame) -> DataFrame:
    """merged, inserted, conflicted: one row."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return merged.agg(zero(F.sum("n_merged")).alias("merged"), F.count_if(F.col("outcome") == "inserted").alias("inserted"), zero(F.sum("n_conflicted")).alias("conflicted"))


def fill_merge(existing: DataFrame, incoming: DataFrame, fills: tuple[str, ...], lists: tuple[str, ...], confidence: str = "confidence", key: str = "dedup_key") -> DataFrame:
    """As the service's own merge of two dicts: missing fields (null) filled, lists extended by what is new, the mean confidence;
    unmatched rows of either side stay. One join."""
    cols = [*fills, *lists, confidence]
    of = lambda df, p: df.select(key, F.lit(True).alias(f"{p}_"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = of(existing, "e").join(of(incoming, "i"), key, "full")
    both = F.col("e_").isNotNull() & F.col("i_").isNotNull()
    pair = lambda c: (F.col(f"e_{c}"), F.col(f"i_{c}"))
    out = [key, *[F.coalesce(*pair(c)).alias(c) for c in fills]]
    out += [F.when(both & pair(c)[0].isNotNull() & pair(c)[1].isNotNull(), F.array_union(*pair(c))).otherwise(F.coalesce(*pair(c))).alias(c) for c in lists]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(*out, F.when(both, (zero(pair(confidence)[0]) + zero(pair(confidence)[1])) / 2).otherwise(F.coalesce(*pair(confidence))).alias(confidence))


#: From so many halvings on a term is 0 in double precision.
_HALVINGS = 1100


def flush(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """key, id, n, confidence, source_chunk_ids: nodes of one batch merged on type and lower-cased label, in the order of ``seq``.

    The id is the first's; the confidence is the ordered mean (c + i) / 2, which is a sum weighted by powers of a half, taken
    in that order, so that it is the same in every run; terms that are 0 in double precision are not gathered. Chunk ids are
    gathered as distinct pairs. Nodes are numbered by ranges of (key, ``seq``), so a key of very many nodes is dealt
    to many tasks.
    """
    key = F.concat_ws("::", F.coalesce("entity_type", F.lit("Concept")), F.lower("label"))
    rows = numbered(nodes.withColumn("key", key).withColumn("by_", F.struct("key", seq, "id")), "by_")
    ends = rows.groupBy("key").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.min_by("id", "sequence").alias("id"), F.count("*").alias("n"))
    behind = (F.col("hi") - F.col("sequence")).cast("double")
    weight = F.when(F.col("sequence") == F.col("lo"), F.pow(F.lit(0.5), behind)).otherwise(F.pow(F.lit(0.5), behind + 1))
    terms = rows.join(ends.select("key", "lo", "hi"), "key").where(behind < _HALVINGS).select("key", F.struct("sequence", (weight * F.coalesce("confidence", F.lit(0.0))).alias("x")).alias("t"))
    means = terms.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("t")), F.lit(0.0), lambda s, t: s + t["x"]).alias("confidence"))  # _HALVINGS rows a key
    chunks = rows.select("key", F.explode("source_chunk_ids").alias("c")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("c")).alias("source_chunk_ids"))
    none = F.array().cast(nodes.schema["source_chunk_ids"].dataType)
    return ends.join(means, "key").join(chunks, "key", "left").select("key", "id", "n", "confidence", F.coalesce("source_chunk_ids", none).alias("source_chunk_ids"))


def feed(nodes: DataFrame, edges: DataFrame, path: str, checkpoint: str, strategy: str = "field_overwrite", keep: int = 2) -> None:
    """Two streams of incremental nodes and edges, merged into a collection in micro-batches; then dangling edges are pruned.

    ``nodes`` and ``edges`` have the collection's columns and ``seq``. A batch writes the version of its number from the one
    before it, so a batch that is replayed writes the same version again; the last ``keep`` versions stay.
    """
    for name, stream, of_edges in (("nodes", nodes, False), ("edges", edges, True)):
        _drain(stream, f"{path}/{name}", f"{checkpoint}/{name}", strategy, of_edges, keep)
    spark = nodes.sparkSession
    kept = [latest_version(spark, f"{path}/{name}") for name in ("nodes", "edges")]
    if None not in kept:
        prune_dangling(kept[1], kept[0]).write.mode("overwrite").parquet(f"{path}/linked")


def _drain(stream: DataFrame, path: str, checkpoint: str, strategy: str, of_edges: bool, keep: int) -> None:
    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions(spark, path) if v < number]
        held = spark.read.parquet(f"{path}/v{before[-1]}") if before else batch.drop("seq").limit(0)
        write_version(merge_into(held, batch, strategy, of_edges).drop("outcome", "n_merged", "n_conflicted"), path, number, keep)

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
