"""Graph construction: resolution, edges, ontology validation, pruning, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.operators.store import numbered
from quillgraph.session import steps, written

# The default ontology, entity types with subtypes and relation types with domain, range and symmetry.
ENTITY_TYPES = {
    "PERSON": ["Researcher", "Executive", "Judge", "Lawyer", "Petitioner", "Respondent", "Witness"],
    "ORGANIZATION": ["Company", "GovernmentAgency", "NGO", "University", "Court"],
    "LOCATION": ["Country", "City", "Region", "Jurisdiction"],
    "CONCEPT": ["Technology", "Product", "LegalConcept", "DefinedTerm"],
    "EVENT": ["CourtCase", "LegislationTitle"],
    "DOCUMENT": [], "DATE": [], "MONEY": [], "PERCENT": [], "LAW": [], "COURT_CASE": [], "COURT": [], "LEGISLATION_TITLE": [],
    "LEGISLATION_REFERENCE": [], "STATUTE_SECTION": [], "JURISDICTION": [], "LEGAL_CONCEPT": [], "DEFINED_TERM": [], "CASE_CITATION": [],
}
_ANY = ["PERSON", "ORGANIZATION", "LOCATION", "CONCEPT", "EVENT"]
RELATION_TYPES = {
    "works_at": (["PERSON"], ["ORGANIZATION"], False),
    "located_in": (["ORGANIZATION", "PERSON", "LOCATION"], ["LOCATION"], False),
    "mentions": (_ANY, _ANY, False),
    "related_to": (["CONCEPT"], ["CONCEPT"], True),
    "co_occurrence": ([*_ANY, "COURT_CASE", "LEGISLATION_TITLE"], [*_ANY, "COURT_CASE", "LEGISLATION_TITLE"], True),
}


def aggregate_entities(tags: DataFrame, min_chunks: int = 2) -> DataFrame:
    """(chunk, label, text, score, seq) -> one row a (label, normalised text) in at least ``min_chunks`` chunks."""
    keyed = tags.withColumn("key", F.concat_ws("::", "label", S.normalize_name(F.col("text"))))
    out = keyed.groupBy("key").agg(
        F.count_distinct("chunk").alias("n_chunks"), F.least(F.avg("score"), F.lit(1.0)).alias("confidence"), F.min_by("text", "seq").alias("name"), F.array_sort(F.collect_set("text")).alias("aliases")
    )
    return out.where(F.col("n_chunks") >= min_chunks)


def cooccurrence(members: DataFrame, chunk: str, entity: str, least: int = 1) -> DataFrame:
    """Unordered pairs of entities by shared chunks: a, b, n, weight. Pairs are made in each chunk's own set."""
    sets = members.select(chunk, entity).distinct().groupBy(chunk).agg(F.array_sort(F.collect_list(entity)).alias("es"))
    pairs = sets.select(F.posexplode("es").alias("i", "a"), "es").select("a", F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("b"))
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.withColumn("weight", S.cooccurrence_weight(F.col("n")))


def relations_to_edges(relations: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, predicate, confidence) by names -> src, dst ids; rows with an unknown name go."""
    a = names.select(F.col("name").alias("source"), F.col("id").alias("src"))
    b = names.select(F.col("name").alias("target"), F.col("id").alias("dst"))
    return relations.join(a, "source").join(b, "target").select("src", "dst", S.parse_type(F.col("predicate"), S.EDGE_TYPES).alias("edge_type"), F.col("confidence").alias("weight"))


#: Names of up to so many characters meet by their deletions, longer ones by segments.
_BY_DELETION = 24


def _deletions(name: Column) -> Column:
    """Hashes of a name and of what is left without any one or two of its characters."""
    n = F.length(name)
    cut = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))
    upto = lambda m: F.sequence(F.lit(1), m)
    one = F.when(n > 0, F.transform(upto(n), lambda i: cut(name, i))).otherwise(F.array().cast("array<string>"))
    two = F.when(n > 1, F.flatten(F.transform(upto(n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: cut(cut(name, i), j))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array(name), one, two), lambda s: F.xxhash64(s)))


def _segment(name: Column, size: Column, k: int, shift: int = 0) -> Column:
    """The k-th third of a name of ``size`` characters, moved by ``shift``, with its place and the size, hashed."""
    lo, hi = F.floor(size * k / 3).cast("int"), F.floor(size * (k + 1) / 3).cast("int")
    return F.xxhash64(size.cast("int"), F.lit(k), F.substring(name, lo + 1 + shift, hi - lo))


def _meeting(name: Column, probing: bool) -> Column:
    """Join keys of which two names within two edits share one: what deletions leave of short names, and thirds of long ones, of
    which two edits leave one whole and at most two characters away; the probing side tries all sizes and places."""
    n, none = F.length(name), F.array().cast("array<bigint>")
    if probing:
        segments = [_segment(name, n + d, k, shift) for d in range(-2, 3) for k in range(3) for shift in range(-2, 3)]
    else:
        segments = [_segment(name, n, k) for k in range(3)]
    return F.concat(F.when(n <= _BY_DELETION + 2, _deletions(name)).otherwise(none), F.when(n > _BY_DELETION, F.array_distinct(F.array(*segments))).otherwise(none))


def resolve(candidates: DataFrame, existing: DataFrame, similar: float = 0.92) -> DataFrame:
    """candidate id -> outcome (exact, fuzzy, new) and the matched id.

    Exact: equal normalised name or alias, whatever the type; the first by ``seq``. Fuzzy: same type, at most two edits and
    cosine above ``similar``. Names meet by deletion neighbourhoods, so the pairs compared follow the names that are close, not
    all of a type and length; only ids and names move until the edits are counted.
    """
    known = existing.select("id", "seq", F.explode(F.array_union(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    known = known.select("id", "seq", S.normalize_name(F.col("n")).alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min_by("id", "seq").alias("exact_id"))
    cands = candidates.withColumn("norm", S.normalize_name(F.col("name")))
    done = cands.join(known, "norm", "left")
    open_ = done.where("exact_id IS NULL").select("cid", "entity_type", "norm")
    left = open_.select("cid", "entity_type", "norm", F.explode(_meeting(F.col("norm"), True)).alias("key"))
    names = existing.select(F.col("id").alias("eid"), F.col("seq").alias("eseq"), "entity_type", S.normalize_name(F.col("label")).alias("en"))
    right = names.select("eid", "eseq", "entity_type", "en", F.explode(_meeting(F.col("en"), False)).alias("key"))
    close = left.join(right, ["entity_type", "key"]).where(F.levenshtein("norm", "en", 2) >= 0).select("cid", "eid", "eseq").distinct()
    near = close.join(candidates.select("cid", F.col("embedding").alias("ce")), "cid").join(existing.select(F.col("id").alias("eid"), F.col("embedding").alias("ee")), "eid")
    fuzzy = near.where(S.cosine(F.col("ce"), F.col("ee")) > similar).groupBy("cid").agg(F.min_by("eid", "eseq").alias("fuzzy_id"))
    out = done.join(fuzzy, "cid", "left")
    return out.select("cid", F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("fuzzy_id").isNotNull(), "fuzzy").otherwise("new").alias("outcome"), F.coalesce("exact_id", "fuzzy_id").alias("node_id"))


def entity_problem(name: Column, kind: Column, confidence: Column, least: float) -> Column:
    """The first rule that fails, or null."""
    known = [t for k, subs in ENTITY_TYPES.items() for t in (k, *subs)]
    return (
        F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "EmptyEntityName")
        .when(~F.coalesce(kind.isin(known), F.lit(False)), "UnknownEntityType")
        .when(confidence < least, "ConfidenceBelowThreshold")
    )


def with_subtypes(types: list[str]) -> list[str]:
    return sorted({t for x in types for t in (x, *ENTITY_TYPES.get(x, []))})


def ancestors(types: DataFrame, parents: DataFrame) -> DataFrame:
    """(t, up): every type with itself and all types above it. ``parents``: t, p. One round a level, until none is new."""
    with steps(types.sparkSession) as keep:
        links = parents.select(F.col("t").alias("up"), "p")
        front = written(types.select("t", F.col("t").alias("up")).distinct())
        out = front
        while True:
            front = written(front.join(links, "up").select("t", F.col("p").alias("up")).distinct().join(out, ["t", "up"], "left_anti"))
            if front.isEmpty():
                return keep(out)
            out = out.unionByName(front)


def relation_problem(predicate: Column, source_type: Column, target_type: Column) -> Column:
    """Unknown predicate, or an endpoint that is not valid or of a type outside domain or range."""
    out = F.when(~predicate.isin(list(RELATION_TYPES)), "UnknownRelationshipType").when(source_type.isNull() | target_type.isNull(), "InvalidDomain")
    for p, (domain, range_, _) in RELATION_TYPES.items():
        out = out.when((predicate == p) & (~source_type.isin(with_subtypes(domain)) | ~target_type.isin(with_subtypes(range_))), "InvalidDomain")
    return out


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def prune_dangling_hyper(edges: DataFrame, nodes: DataFrame, key: str = "edge_id", participants: str = "participants") -> DataFrame:
    """Hyperedges with participants, all of them among the nodes."""
    ids = nodes.select(F.col("id").alias("p")).distinct().withColumn("known", F.lit(True))
    parts = edges.select(key, F.explode(participants).alias("p")).join(ids, "p", "left")
    good = parts.groupBy(key).agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ok")).where("ok")
    return edges.join(good.select(key), key, "left_semi")


def prune_low_weight(edges: DataFrame, least: float = 0.3, max_degree: int = 100) -> DataFrame:
    """Edges of weight ``least`` or more, of each source the ``max_degree`` heaviest; ties by target."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.where(F.col("weight") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_degree).drop("rank")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour, direction) of binary and hyper edges; a hyperedge joins all ordered pairs of participants."""
    out = edges.where("participants IS NULL").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.where("participants IS NULL").select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    hyper = edges.where("participants IS NOT NULL").select(F.explode("participants").alias("node"), "participants").select("node", F.explode("participants").alias("neighbour"), F.lit("out").alias("direction")).where("node <> neighbour")
    return out.unionByName(into).unionByName(hyper)


def overwrite(existing: DataFrame, incoming: DataFrame, key: str = "dedup_key", ident: str = "id", joined: tuple = (), unions: tuple = (), fills: tuple = (), means: tuple = (), maps: tuple = ()) -> DataFrame:
    """Field-by-field merge of rows matched on ``key``; unmatched ones of either side stay as they are.

    ``joined`` texts of both sides are put one after the other; ``unions`` append what is new; ``fills`` only fill what is
    missing (null or empty); ``means`` are averaged; ``maps`` keep the existing entries and add new keys. One join.
    """
    cols = [ident, *joined, *unions, *fills, *means, *maps]
    side = lambda df, p: df.select(key, F.lit(True).alias(f"{p}_"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = side(existing, "e").join(side(incoming, "i"), key, "full")
    both = F.col("e_").isNotNull() & F.col("i_").isNotNull()
    first = lambda c: F.coalesce(f"e_{c}", f"i_{c}")
    e, i = (lambda c: F.col(f"e_{c}")), (lambda c: F.col(f"i_{c}"))
    out = [key, F.when(F.col("e_").isNotNull(), e(ident)).otherwise(i(ident)).alias(ident)]
    out += [F.when(e(c).isNotNull() & i(c).isNotNull(), F.concat_ws(" | ", e(c), i(c))).otherwise(first(c)).alias(c) for c in joined]
    out += [F.when(e(c).isNotNull() & i(c).isNotNull(), F.array_union(e(c), i(c))).otherwise(first(c)).alias(c) for c in unions]
    empty = lambda c: F.when(c.cast("string") != "", c)
    out += [F.coalesce(empty(e(c)), i(c), e(c)).alias(c) for c in fills]
    out += [F.when(both, (e(c) + i(c)) / 2).otherwise(first(c)).alias(c) for c in means]
    fresh = lambda c: F.map_filter(i(c), lambda k, _: ~F.map_contains_key(e(c), k))
    out += [F.when(e(c).isNotNull() & i(c).isNotNull(), F.map_concat(e(c), fresh(c))).otherwise(first(c)).alias(c) for c in maps]
    return j.select(*out)


#: How the fields of nodes and of edges are merged.
NODE_FIELDS = {"joined": ("description",), "unions": ("aliases", "doc_origins"), "fills": ("display_label", "ontology_class"), "means": ("confidence",), "maps": ("properties",)}
EDGE_FIELDS = {"joined": ("context",), "unions": ("participants", "doc_origins"), "fills": ("predicate", "time", "location", "display_label"), "means": ("weight",), "maps": ("properties",)}


def merge_nodes(existing: DataFrame, incoming: DataFrame, strategy: str = "field_overwrite") -> DataFrame:
    """Nodes joined on ``dedup_key``; unmatched ones of either side stay. Fields that a side has no column for are left out."""
    return _merged(existing, incoming, strategy, NODE_FIELDS)


def merge_edges(existing: DataFrame, incoming: DataFrame, strategy: str = "field_overwrite") -> DataFrame:
    """As ``merge_nodes``, for edges."""
    return _merged(existing, incoming, strategy, EDGE_FIELDS)


def _merged(existing: DataFrame, incoming: DataFrame, strategy: str, fields: dict[str, tuple]) -> DataFrame:
    held = {k: tuple(c for c in v if c in existing.columns and c in incoming.columns) for k, v in fields.items()}
    if strategy == "field_overwrite":
        return overwrite(existing, incoming, **held)
    cols = [c for v in held.values() for c in v]
    side = lambda df, p: df.select("dedup_key", F.struct("id", *cols).alias(p))
    j = side(existing, "e").join(side(incoming, "i"), "dedup_key", "full")
    row = F.coalesce("e", "i") if strategy == "keep_first" else F.coalesce("i", "e")
    return j.select("dedup_key", row.alias("row"), F.coalesce("e", "i").alias("first")).select("dedup_key", "first.id", *[f"row.{c}" for c in cols])


def merge_resolved(canonical: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    """(id, confidence, aliases, description) of each canonical node after the incoming entities resolved to it, in the
    order of ``seq``: names and aliases appended once, confidence halved towards each, the longer description taken.

    ``canonical``: id, confidence, aliases, description; ``incoming``: id, ``seq``, name, aliases, confidence, description.
    The ordered mean is a sum weighted by powers of a half, entities are numbered by ranges of (id, ``seq``), and the aliases
    are folded by distinct name, so no task gathers a node's entities; only its distinct aliases meet in one row.
    """
    rows = numbered(incoming.withColumn("by_", F.struct("id", seq)), "by_").drop("by_")
    ends = rows.groupBy("id").agg(F.min("sequence").alias("lo_"), F.count("*").alias("n"))
    at = rows.join(ends.select("id", "lo_"), "id").withColumn("at", F.col("sequence") - F.col("lo_") + 1).drop("sequence", "lo_")
    n = ends.select("id", "n")
    means = at.join(n, "id").groupBy("id").agg(F.max("n").alias("n"), F.sum(F.col("confidence") * F.pow(F.lit(0.5), F.col("n") - F.col("at") + 1)).alias("part"), F.max(F.struct(F.length("description").alias("size"), (-F.col("at")).alias("first"), "description")).alias("long"))
    names = at.select("id", "at", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("pos", "alias"))
    fresh = names.groupBy("id", "alias").agg(F.min(F.struct("at", "pos")).alias("seen")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "alias"))), lambda x: x["alias"]).alias("fresh"))
    j = canonical.select("id", "confidence", "aliases", "description").join(means, "id", "left").join(fresh, "id", "left")
    got = F.col("n").isNotNull()
    longer = got & (F.col("long.size") > F.length(F.coalesce("description", F.lit(""))))
    return j.select(
        "id", F.when(got, F.col("confidence") * F.pow(F.lit(0.5), F.col("n")) + F.col("part")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(got, F.array_union("aliases", "fresh")).otherwise(F.col("aliases")).alias("aliases"), F.when(longer, F.col("long.description")).otherwise(F.col("description")).alias("description"),
    )


def conflicts(existing: DataFrame, incoming: DataFrame, fields: list[str], key: str = "dedup_key") -> DataFrame:
    """(key, field, a, b) of every field that differs between matched rows."""
    e = existing.select(key, *[F.col(c).cast("string").alias(f"e_{c}") for c in fields])
    i = incoming.select(key, *[F.col(c).cast("string").alias(f"i_{c}") for c in fields])
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"e_{c}").alias("a"), F.col(f"i_{c}").alias("b")) for c in fields])
    return e.join(i, key).select(key, F.inline(each)).where(~F.col("a").eqNullSafe(F.col("b")))


def running_mean(rows: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Ordered fold (c + i) / 2 of a key's values; values of one key are merged in the order of ``seq``."""
    vs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).cast("double").alias("v"))))
    g = rows.groupBy(key).agg(vs.alias("vs"))
    return g.select(key, F.aggregate(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0))), F.element_at("vs", 1)["v"], lambda a, x: (a + x["v"]) / 2).alias("confidence"), F.size("vs").alias("n"))
