"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every metric of a text is computed in one pass of Spark expressions; the verdict is the conjunction of the rows of the
threshold table. There is no shuffle, no user function and no state beyond one row.

Defined cases: a null or empty text has no words and fails ``base``; rows keep their number, repeats included; an empty
table gives an empty table; the caller's other columns pass through, those named as an output are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import SPACE, let, text_of, words

# Frequent function words of English, Spanish, German and French.
STOP_WORDS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were which with "
    "como con de del el en es la las los no para por que se su un una y "
    "als auch auf aus das dem den der des die ein eine ist mit nicht sich und von zu "
    "au avec ce dans des du elle est et il le les ne ou par pas pour qui sur une"
).split()
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A text passes while ``low <= metric <= high``."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. Ratios are per word, per word character or per line.
RULES = (
    Rule("word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.05),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("stutter", "stutter_ratio", None, 0.3),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def _repeat_words(ws: Column, n: Column) -> Column:
    """Words inside an 8-word window that is found twice or more in the text.

    Windows are compared by 64-bit hashes of word hashes, within one text only. The sort of (hash, place) runs just for
    texts in which some window repeats.
    """
    places = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))

    def covered(h: Column) -> Column:
        def runs(s: Column) -> Column:
            same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
            twice = F.filter(s, lambda p, j: same(p, F.get(s, j - 1)) | same(p, F.get(s, j + 1)))
            return let(
                F.array_sort(F.transform(twice, lambda p: p["i"])),
                lambda at: F.aggregate(
                    F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            )

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, runs))

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return let(hashed, lambda hw: let(F.transform(places, lambda i: F.xxhash64(F.slice(hw, i, WINDOW))), covered))


def metrics(text: Column) -> Column:
    """All counts of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(ws: Column, ls: Column) -> Column:
        n = F.size(ws)
        stop = F.filter(ws, lambda w: F.lower(F.rtrim(w, F.lit(".,!?;:"))).isin(STOP_WORDS))
        stutter = F.filter(ws, lambda w, i: F.coalesce(w == F.get(ws, i - 1), F.lit(False)))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(ws, n).cast("long").alias("n_repeat_words"),
            F.size(stop).cast("long").alias("n_stop_words"),
            F.size(stutter).cast("long").alias("n_stutter"),
        )

    return let(words(text), lambda w: let(lines, lambda ls: of(w, ls)))


def ratios(m: Column) -> dict[str, Column]:
    """The metrics that rules may name."""
    per = lambda a, b: m[a] / F.greatest(m[b], F.lit(1))
    return {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "stop_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stutter_ratio": per("n_stutter", "n_words"),
    }


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and the comma-joined ``failed_rules``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"]
    held = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    found = docs.select(*held, metrics(text_of(F.col(f"`{text}`"))).alias("__m"))
    m = F.col("__m")
    known = ratios(m)
    failed = []
    for r in rules:
        x = known[r.metric]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (x < r.low)
        if r.high is not None:
            bad = bad | (x > r.high)
        failed.append(F.when(bad, F.lit(r.name)))
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    why = F.concat_ws(",", *failed)
    return found.select(
        *held, *(m[c].alias(c) for c in names[:5]), base.alias("base_failed"), (~base & (why == "")).alias("kept"), why.alias("failed_rules")
    )


def _sql_rules() -> str:
    at = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
        "stop_ratio": "n_stop / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "stutter_ratio": "n_stutter / greatest(n_words, 1)",
    }
    parts = []
    for r in RULES:
        bad = [f"{at[r.metric]} {o} {v}" for o, v in (("<", r.low), (">", r.high)) if v is not None]
        parts.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return ", ".join(parts)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
r AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM r),
g AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM c WHERE n > 1),
p AS (SELECT doc_id, sum(k)::BIGINT AS n FROM g GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(rtrim(x, '.,!?;:')) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop,
         len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id),
v AS (SELECT *, concat_ws(',', {_sql_rules()}) AS failed_rules, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""
