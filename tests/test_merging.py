"""Ordered merges against folding one row after the other."""

import random

import pytest

from quillgraph.operators import merging as M

NODE = "id string, dedup_key string, label string, description string, confidence double, aliases array<string>, ontology_class string, display_label string, properties map<string,string>"


def rows(seed, n, prefix, keys, seq=False):
    r = random.Random(seed)
    out = []
    for k in range(n):
        maybe = lambda x: x if r.random() < 0.7 else None  # noqa: B023, E731
        row = (f"{prefix}{k:03d}", r.choice([*keys, None]), r.choice("AB"), maybe(f"d{r.randint(0, 3)}"), maybe(r.choice([0.2, 0.5, 1.0])), maybe([r.choice("xyz") for _ in range(r.randint(0, 2))]), maybe(r.choice(["", "C"])), None, maybe({r.choice("pq"): str(k)}))
        out.append((*row, k) if seq else row)
    return out


def fold(existing, incoming, strategy):
    """One row after the other, over a plain list."""
    held, inserted, merged, conflicted = [list(x) for x in sorted(existing)], [], 0, 0
    for *new, _ in incoming:
        old = next((h for h in held if h[1] is not None and h[1] == new[1]), None)
        if old is None:
            inserted.append(new)
            continue
        merged += 1
        conflicted += any(old[k] != new[k] for k in range(2, 8))
        if strategy == "keep_last":
            old[1:] = new[1:]
        if strategy == "field_overwrite":
            both = lambda k, f: f(old[k], new[k]) if old[k] is not None and new[k] is not None else old[k] if old[k] is not None else new[k]  # noqa: B023, E731
            old[3] = both(3, lambda a, b: f"{a} | {b}")
            old[4] = both(4, lambda a, b: (a + b) / 2)
            old[5] = both(5, lambda a, b: list(dict.fromkeys(a + b)))
            old[6] = old[6] if old[6] not in (None, "") else new[6] if new[6] is not None else old[6]
            old[8] = both(8, lambda a, b: {**b, **a})
    return held + inserted, merged, len(inserted), conflicted


def plain(row):
    return tuple(repr(x if not isinstance(x, dict) else sorted(x.items())) if x is not None else None for x in row)


@pytest.mark.parametrize("strategy", M.STRATEGIES)
def test_merge_into(spark, strategy):
    old, new = rows(1, 40, "e", [f"k{i}" for i in range(25)]), rows(2, 120, "i", [f"k{i}" for i in range(40)], True)
    e, i = spark.createDataFrame(old, NODE).repartition(3), spark.createDataFrame(new, NODE + ", seq long").repartition(3)
    out = M.merge_into(e, i, strategy)
    want, merged, inserted, conflicted = fold(old, new, strategy)
    got = [r[:9] for r in out.collect()]
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)
    assert tuple(M.report(out).first()) == (merged, inserted, conflicted) and merged > 20 and conflicted > 5
    assert tuple(M.report(M.merge_into(e, i.where("false"), strategy)).first()) == (0, 0, 0)
    assert M.merge_into(e.where("false"), i, strategy).count() == len(new)
    with pytest.raises(ValueError, match="strategy"):
        M.merge_into(e, i, "other")


def test_flush(spark):
    r = random.Random(5)
    ns = [(f"n{k}", r.choice(["PERSON", None]), r.choice(["Ann", "ANN", "bob"]), r.choice([0.1, 0.9, None]), [r.choice("abc") for _ in range(r.randint(0, 2))] if k % 4 else None, k) for k in range(60)]
    want = {}
    for i, kind, label, c, chunks, _ in ns:
        key = f"{kind or 'Concept'}::{label.lower()}"
        if key in want:
            h = want[key]
            h[1:] = [h[1] + 1, (h[2] + (c or 0.0)) / 2, h[3] | set(chunks or [])]
        else:
            want[key] = [i, 1, c or 0.0, set(chunks or [])]
    got = {x.key: [x.id, x.n, pytest.approx(x.confidence), set(x.source_chunk_ids)] for x in M.flush(spark.createDataFrame(ns, "id string, entity_type string, label string, confidence double, source_chunk_ids array<string>, seq long").repartition(3)).collect()}
    assert got == want


def test_fill_merge(spark):
    schema = "dedup_key string, a string, xs array<string>, confidence double"
    e = spark.createDataFrame([("k", None, ["x"], 0.5), ("o", "q", None, None), ("z", "w", ["y"], 1.0)], schema)
    i = spark.createDataFrame([("k", "v", ["y", "x"], 1.0), ("o", "r", ["n"], 1.0), ("m", "s", None, 0.25)], schema)
    got = {r[0]: tuple(r)[1:] for r in M.fill_merge(e, i, ("a",), ("xs",)).collect()}
    assert got == {"k": ("v", ["x", "y"], 0.75), "o": ("q", ["n"], 0.5), "z": ("w", ["y"], 1.0), "m": ("s", None, 0.25)}


def test_feed_folds_across_batches_and_replays(spark, tmp_path):
    new = rows(3, 90, "i", [f"k{i}" for i in range(20)], True)
    old = rows(4, 10, "e", [f"k{i}" for i in range(10)])
    first = [(*x, -1) for x in old]
    for k, part in enumerate([first, new[:30], new[30:60], new[60:]]):
        spark.createDataFrame(part, NODE + ", seq long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n{k}")
        edge = [(f"x{k}", None, f"e00{k}", "e001" if k < 3 else "nobody", k)]
        spark.createDataFrame(edge, "id string, dedup_key string, src string, dst string, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/e{k}")
        read = lambda kind, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{kind}*")
        M.feed(read("n", NODE + ", seq long"), read("e", "id string, dedup_key string, src string, dst string, seq long"), f"{tmp_path}/out", f"{tmp_path}/cp", "field_overwrite")
    want = old
    for part in (new[:30], new[30:60], new[60:]):
        want = fold(want, part, "field_overwrite")[0]
    after = M.latest_version(spark, f"{tmp_path}/out/nodes")
    assert sorted((plain(r) for r in after.collect()), key=str) == sorted(map(plain, want), key=str)
    assert {(r.src, r.dst) for r in spark.read.parquet(f"{tmp_path}/out/linked").collect()} == {("e000", "e001"), ("e001", "e001"), ("e002", "e001")}
    assert len([p for p in (tmp_path / "out/nodes").iterdir() if p.name[0] == "v"]) == 2
    M._drain(spark.readStream.schema(NODE + ", seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/n*"), f"{tmp_path}/out/nodes", f"{tmp_path}/cp/nodes", "field_overwrite", False, 2)
    assert sorted((plain(r) for r in M.latest_version(spark, f"{tmp_path}/out/nodes").collect()), key=str) == sorted(map(plain, want), key=str)


def test_flush_sums_in_order(spark):
    """Confidences to the last bit, however the rows lie in partitions."""
    from pyspark.sql import functions as F

    rows = spark.range(2000).select("id", F.lit("T").alias("entity_type"), F.concat(F.lit("N"), (F.col("id") % 100).cast("string")).alias("label"), (F.pmod(F.hash("id"), F.lit(10)) / 10.0).alias("confidence"), F.array(F.col("id") % 3).alias("source_chunk_ids"), F.col("id").alias("seq"))
    by_key = {}
    for r in rows.orderBy("id").collect():
        by_key.setdefault(f"T::{r.label.lower()}", []).append(r.confidence)
    want = {}
    for k, cs in by_key.items():
        total = 0.0
        for i, c in enumerate(cs):
            total += c * 0.5 ** (len(cs) - 1 if i == 0 else len(cs) - i)
        want[k] = total
    got = M.flush(rows.repartition(7, F.hash(F.col("id") * 31))).collect()
    assert {r.key: r.confidence for r in got} == want and all(r.n == 20 for r in got)
