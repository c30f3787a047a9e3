"""Soft-membership mixing: document rates whose expected domain token totals match target weights. DataFrame work only.

The labelled table gives three domains: ``good`` (quality 1, not toxic), ``poor`` (quality 0, not toxic) and ``toxic``.
A classifier with a head for quality and one for toxicity sums the log odds of presence and absence of telling tokens, chosen by
information over a hash-drawn set of about ``FIT_ROWS`` labelled rows. It is compiled into the projection as a lookup
table of fixed size and gives every document its posteriors.

Rates r >= 0 minimise the relative squared distance between expected domain totals T (sums of rate x tokens x posterior) and
the targets g, plus ``RIDGE`` times the tokens' squared distance of their rates from 1, which makes the optimum unique. The
projected gradient step from rate 1 is r = max(0, 1 - posterior . v), where v is the gradient's weight of each domain, a few
numbers; at the optimum v = (T(v) - g) / (held x ``RIDGE``). Each iteration moves v along the gradient, scaled by the
curvature of the rates that are not at 0, with the best of ``STEPS``: two aggregations of a few sums over the compact table
(id, tokens, posteriors), whatever the number of step sizes. Rates are never stored between iterations, and no exchange
carries more than one row of sums a task. The total is set so that the ``good`` domain keeps its tokens. Rates are rounded to
0.01; ``copies`` is the floor, and one more for the remainder's share of documents by a hash of the row.

Defined cases: a null or empty text has 0 tokens and the prior's posteriors; repeated rows get the same rate and copies; a
side of a head without labels has no members, and without any labels every text is good; a null id has no label; an empty
table gives an empty one; a label row with a null is not learned from; of several label rows of an id one counts; only the
named columns are read.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillgraph.llm.columns import let, text_of, words
from quillgraph.session import cut

HEADS = ("quality", "toxic")
DOMAINS = ("good", "poor", "toxic")
#: Target shares of tokens.
TARGETS = {"good": 0.97, "poor": 0.03, "toxic": 0.0}
FIT_ROWS, FEATURES, MIN_DOCS, SLOTS = 20_000, 128, 8, 1 << 13
MIN_SHARE = 0.02  # of the rows of the side that a token speaks for
MIN_ODDS = 2.5  # log odds under which a token tells too little; sums of many weak, dependent tokens mislead
SURE = 50.0
RIDGE, ITERATIONS, CLOSE = 1e-3, 20, 1e-6
#: A gradient beyond this share of a domain's tokens is reported.
FAR = 1e-4
STEPS = [0.5**k for k in range(8)]


def features(text: Column) -> Column:
    """Distinct lower-cased letter runs and runs of symbols."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+|[#*$%&|<>!]+"), F.lit(0)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[float], list[tuple[int, list[float]]]]:
    """(log odds by head of a text without any telling token, (token hash, log odds by head) of the telling tokens); at most FEATURES rows are collected."""
    named = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.col(h) == 1).alias(h) for h in HEADS])  # of contradicting labels the positive one
    share = min(1.0, FIT_ROWS / max(1, named.count()))
    drawn = named.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = cut(docs.select("doc_id", text_of("text").alias("text")).join(drawn, "doc_id").select(*HEADS, features(F.col("text")).alias("f")))
    sides = [(h, v, F.count(F.when(F.col(h) == v, 1)).alias(f"{h}_{v}")) for h in HEADS for v in (True, False)]
    n = rows.agg(*[c for _, _, c in sides]).first().asDict()  # one row
    counts = rows.select(*HEADS, F.explode("f").alias("t")).groupBy("t").agg(F.count("*").alias("df"), *[c for _, _, c in sides])

    def gain(h: str) -> Column:
        """Information of a token's presence and absence about a head."""
        yes, no = n[f"{h}_True"], n[f"{h}_False"]
        if not yes or not no:
            return F.lit(0.0)
        part = lambda k, total, of: F.when(k > 0, k * F.ln(k * (yes + no) / (F.greatest(total, F.lit(1)) * of))).otherwise(0.0)
        a, b = F.col(f"{h}_True"), F.col(f"{h}_False")
        weight = F.abs(F.ln((a + 0.5) / (yes + 1) * (no + 1) / (b + 0.5)))
        rare = F.greatest(a / yes, b / no) < MIN_SHARE
        return F.when((weight < MIN_ODDS) | rare, 0.0).otherwise(part(a, a + b, yes) + part(b, a + b, no) + part(yes - a, (yes + no) - a - b, yes) + part(no - b, (yes + no) - a - b, no))

    best = counts.where(F.col("df") >= MIN_DOCS).withColumn("g", F.greatest(*map(gain, HEADS))).where("g > 8").orderBy(F.desc("g"), "t").limit(FEATURES)

    def odds(r: Row, h: str) -> tuple[float, float]:
        """Log odds of presence less those of absence, and those of absence."""
        a, b, yes, no = r[f"{h}_True"], r[f"{h}_False"], n[f"{h}_True"], n[f"{h}_False"]
        w = math.log((a + 0.5) / (yes + 1) * (no + 1) / (b + 0.5))
        if abs(w) < MIN_ODDS or max(a / max(yes, 1), b / max(no, 1)) < MIN_SHARE:
            return 0.0, 0.0
        absent = math.log((yes - a + 0.5) / (yes + 1) * (no + 1) / (no - b + 0.5))
        return w - absent, absent

    rows_ = best.select(F.xxhash64("t").alias("h"), *[f"{h}_{v}" for h, v, _ in sides]).collect()
    def prior(h: str, unlabelled: float) -> float:
        """A side without labelled rows has no members; without any labels every text is good."""
        yes, no = n[f"{h}_True"], n[f"{h}_False"]
        if not yes or not no:
            return SURE if yes else -SURE if no else unlabelled
        return math.log((yes + 1) / (no + 1)) + sum(odds(r, h)[1] for r in rows_)

    return [prior("quality", SURE), prior("toxic", -SURE)], [(r.h, [odds(r, h)[0] for h in HEADS]) for r in rows_]


def _table(logs: list[tuple[int, list[float]]]) -> tuple[int, int, list[int], list[list[float]]]:
    """(slots, shift, hashes, odds by head): a table by some bits of the hash, with as many slots as give each token its own."""
    slots, want = SLOTS, len({h for h, _ in logs})
    while True:
        at = lambda h, s: h >> s & (slots - 1)  # noqa: B023, E731
        shift = max(range(40), key=lambda s: len({at(h, s) for h, _ in logs}))
        if len({at(h, shift) for h, _ in logs}) == want:
            break
        slots *= 2
    held, odds = [0] * slots, [[0.0] * slots for _ in HEADS]
    for h, w in logs:
        held[at(h, shift)] = h
        for k in range(len(HEADS)):
            odds[k][at(h, shift)] = w[k]
    return slots, shift, held, odds


def _array(values: list, kind: str) -> Column:
    """A constant array; written as text, which Spark folds once, as a column a value would cost a call each."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def posteriors(text: Column, model: tuple[list[float], list[tuple[int, list[float]]]]) -> Column:
    """Array of the domains' posteriors."""
    prior, logs = model
    slots, shift, held, odds = _table(logs)
    slot = lambda h: F.shiftright(h, shift).bitwiseAND(slots - 1).cast("int")
    known = F.filter(F.transform(features(text), lambda t: F.xxhash64(t)), lambda h: F.get(_array(held, "long"), slot(h)) == h)

    def summed(hs: Column, k: int) -> Column:
        return F.aggregate(hs, F.lit(float(prior[k])), lambda a, h: a + F.get(_array(odds[k], "double"), slot(h)))

    chance = lambda x: 1 / (1 + F.exp(-x))
    split = lambda q: F.array((1 - q[1]) * q[0], (1 - q[1]) * (1 - q[0]), q[1])
    return let(known, lambda hs: let(F.array(*[chance(summed(hs, k)) for k in range(len(HEADS))]), split))


def solve(table: DataFrame, goal: list[float], held: list[float]) -> list[float]:
    """The gradient weights v of the optimal rates max(0, 1 - posterior . v); see the module."""
    p, n = [F.col(f"p_{d}") for d in DOMAINS], F.col("n_tokens")
    size, k = [max(h, 1.0) for h in held], len(DOMAINS)

    def off(totals: list[float], v: np.ndarray) -> np.ndarray:
        return v - np.array([(t - g) / (s * RIDGE) for t, g, s in zip(totals, goal, size, strict=True)])

    def sums(cols: list[Column]) -> list[float]:
        return [float(x or 0.0) for x in table.agg(*[F.sum(c).alias(f"s{j}") for j, c in enumerate(cols)]).first()]

    v, now = np.zeros(k), off(held, np.zeros(k))
    for _ in range(ITERATIONS):
        if np.abs(now).max() * RIDGE < CLOSE:
            break
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, sums([F.when(rate(v) > 0, n * p[i] * p[j]) for i, j in pairs]), strict=True):
            curve[i, j] = curve[j, i] = x
        way = -np.linalg.solve(np.eye(k) + curve / (np.array(size) * RIDGE)[:, None], now)
        got = np.array(sums([n * x * rate(v + step * way) for step in STEPS for x in p])).reshape(-1, k)
        tried = [off(list(t), v + step * way) for t, step in zip(got, STEPS, strict=True)]
        best = min(range(len(STEPS)), key=lambda j: float(np.square(tried[j]) @ size))
        if np.square(tried[best]) @ size >= np.square(now) @ size:
            break
        v, now = v + STEPS[best] * way, tried[best]
    left = float(np.abs(now).max() * RIDGE)
    if left > FAR:
        warnings.warn(f"the rates are not at their optimum: a share of {left:.2g} of a domain's tokens is left after {ITERATIONS} steps", stacklevel=2)
    return v.tolist()


def rate(v: Sequence[float]) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, v, strict=True)), F.lit(0.0)))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_tokens, a posterior a domain, rate and copies of each row."""
    model = fit(docs, labels)
    text = text_of("text")
    base = docs.select("doc_id", *carry, F.size(words(text)).cast("long").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("u"), posteriors(text, model).alias("p"))
    table = cut(base.select("doc_id", *carry, "n_tokens", "u", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]))
    held = [float(x or 0.0) for x in table.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in DOMAINS]).first()]
    whole = held[0] / targets["good"] if targets.get("good") else sum(held)
    v = solve(table, [targets.get(d, 0.0) * whole for d in DOMAINS], held)
    out = table.withColumn("rate", F.round(rate(v), 2))
    copies = F.floor(F.col("rate") + F.col("u") / F.lit(float(1 << 30))).cast("long")
    return out.select("doc_id", *carry, "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", copies.alias("copies"))
