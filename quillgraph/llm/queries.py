"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontam, html, langid, lm, minhash, mixing, pieces, quality, sharding, suffix, tokens, treaps, vectors
from quillgraph.session import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and the verdict of the rule table for every whole text. Null and empty texts have no words and fail the base; repeated rows repeat."""
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and byte counts of every whole text. A null text is empty and has no tokens; repeated rows repeat."""
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every row: doc_id and the least id of its class. Texts without words are classes of their own; see ``minhash``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and the hash of what stays, of every row. Null is empty; repeated rows remove each other; see ``suffix``."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, benchmark hits and items of every row. Null has no words; a null item id hits but is not counted; see ``decontam``."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null, empty and articleless pages give the empty text; see ``html``."""
    return html.extract(table(spark, sf_dir, "pages"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language and score of every row. Null texts and texts without a letter are ``und`` with 0; see ``langid``."""
    return langid.language_id(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every row. A null text is its end token; a null id is not held out; see ``lm``."""
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of every row. Null texts have no tokens; rows without a label get the model's posterior; see ``mixing``."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row. Null texts weigh nothing; repeated rows share a bucket until it is full; see ``sharding``."""
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, squared error and error of the label of every kept vector. Null vectors and those with null or non-finite components go; see ``vectors``."""
    coded, books = vectors.compress(table(spark, sf_dir, "embeddings"))
    return vectors.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(vectors.digest(books)).alias("codebooks_sha256"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text that they decode to, as digests. Null is empty and has the two end ids; see ``pieces``."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item. Null texts have no terms; items that no document answers have no rows; see ``treaps``."""
    return treaps.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_quality": op1_quality, "op2_tokens": op2_tokens, "op3_minhash": op3_minhash, "op4_repeats": op4_repeats, "op5_decontaminate": op5_decontaminate, "op6_html": op6_html, "op7_langid": op7_langid, "op8_lm": op8_lm, "op9_mixing": op9_mixing, "op10_sharding": op10_sharding, "op11_vectors": op11_vectors, "op12_pieces": op12_pieces, "op13_search": op13_search}
ORACLE_SQL = {"op1_quality": quality.SQL, "op5_decontaminate": decontam.SQL, "op13_search": treaps.SQL}
