"""A corpus pipeline: language ID, near-duplicates out, personal data masked,
sources mixed, texts encoded. Each stage takes what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.bpe import encode_documents
from pagewright.llm.common import Scratch, table
from pagewright.llm.jaccard import keep_one
from pagewright.llm.langid import keep_identified
from pagewright.llm.mixing import mixed
from pagewright.llm.pii import mask_pii
from pagewright.llm.queries import TOKENIZER

#: Documents whose best language gets less of the pooled probability are
#: rejected, as are those without any letter. Below it are texts of a word or
#: two, noise of signs and one word over and over; about half of them would be
#: given a wrong language.
LEAST_SCORE = 0.45


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the others go."""
    return keep_identified(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return mask_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix encoded and decoded."""
    return encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources", source_mix),
    ("BPE", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.put(out, str(i))
        if i:
            scratch.drop(str(i - 1))
    return docs


#: SQL can express neither the network nor the deobfuscation nor BPE.
ORACLE_SQL = None
