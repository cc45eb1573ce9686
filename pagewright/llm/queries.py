"""Thin queries over the operators; each derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, mixing, secrets, warc
from .bpe import encode_documents
from .common import table
from .jaccard import jaccard_components
from .langid import held_out, identify
from .neardup import near_duplicates
from .pii import find_pii
from .simhash import fingerprints

#: The tokenizer file of op1; never copied into this repository.
TOKENIZER = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all conversations in canonical JSON, with calls and results linked."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, copies."""
    return mixing.rates(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_within."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data: doc_id, base counts, base_sha256, spans (all), n_added."""
    return find_pii(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents: doc_id, n_shingles, component_id."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_on=docs)
    return out.select("doc_id", held_out(out.doc_id).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to WARC archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of secrets: doc_id, start, length, candidate_sha256, score, is_secret."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal vectors: vec_id, n_links, component_id, kept."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_bpe": op1_bpe, "op2_chat": op2_chat, "op3_mixing": op3_mixing, "op4_simhash": op4_simhash, "op5_pii": op5_pii, "op6_jaccard": op6_jaccard, "op7_language_id": op7_language_id, "op8_warc": op8_warc, "op9_secrets": op9_secrets, "op10_embedding_neardup": op10_embedding_neardup}
ORACLES: dict[str, str] = {"op2_chat": chat.ORACLE, "op3_mixing": mixing.ORACLE, "op8_warc": warc.ORACLE}
