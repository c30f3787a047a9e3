"""Pluggable models: a callable over batches of texts, and the plain-SQL rules for what it answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<entities:array<struct<name:string,entity_type:string,confidence:double>>,relationships:array<struct<source:string,target:string,predicate:string,confidence:double>>>"


def ask(rows: DataFrame, model: Callable[[list[str]], list[str]], key: str, text: str, out: str = "answer") -> DataFrame:
    """key and the model's answer for each text; the model is shipped to the workers and sees Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p.iloc[:, 0], out: model([t or "" for t in p.iloc[:, 1]])})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, {out} string")


def unfenced(answer):
    """The JSON object of an answer, without fences and surrounding words."""
    return F.regexp_extract(answer, r"(?s)\{.*\}", 0)


def entities(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """key, name, entity_type, confidence of well-formed answers; blank names go."""
    parsed = answers.select(key, F.inline(F.from_json(unfenced(F.col(answer)), ANSWER)["entities"]))
    return parsed.withColumn("name", F.trim("name")).where("name <> ''")


def relationships(answers: DataFrame, key: str, answer: str = "answer", predicates: list[str] | None = None) -> DataFrame:
    """key, source, target, predicate, confidence; self-relations and unknown predicates go."""
    parsed = answers.select(key, F.inline(F.from_json(unfenced(F.col(answer)), ANSWER)["relationships"])).where("source <> target")
    return parsed.where(F.col("predicate").isin(predicates)) if predicates else parsed


def title_case_model(texts: list[str]) -> list[str]:
    """A deterministic stand-in: at most six capitalised words as entities, one relation between the first two."""
    import json
    import re

    out = []
    for t in texts:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,}\b", t)))[:6]
        rel = [{"source": names[0], "target": names[1], "predicate": "related_to", "confidence": 0.8}] if len(names) > 1 else []
        out.append("```json\n" + json.dumps({"entities": [{"name": n, "entity_type": "CONCEPT", "confidence": 0.9} for n in names], "relationships": rel}) + "\n```")
    return out
