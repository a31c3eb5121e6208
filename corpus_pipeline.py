"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. toxicity: documents predicted toxic go.
2. quality rules: documents that fail them go.
3. n-gram Jaccard join: of each group of near copies one document stays, the one of least doc_id.
4. PII: personal data gives way to surrogates; n_chars follows the new text.
5. best-fit packing: the layout of the kept documents in training sequences, one row per piece.

Stages 1 to 4 return the columns of ``documents``. No stage samples or caps rows. SQL cannot express them (compression
lengths, expectation-maximisation, keyed permutations, bin packing), so ORACLE_SQL is None; tests use brute force.

In every stage a null or empty text has no windows, words, shingles, entities or tokens: the toxicity stage keeps it, the
quality rules drop it (under 50 words). Rows may repeat, ids and other columns may be null, a table may be empty, texts may
have any length, and columns beyond those of ``documents`` are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm import toxicity
from citelens.llm.common import materialise, table
from citelens.llm.jaccard import jaccard_components
from citelens.llm.packing import pack, token_counts
from citelens.llm.pii import replace_pii
from citelens.llm.quality import quality_rules
from citelens.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = "a key that the caller keeps"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows scored under the threshold, repeated ones and those without an id or text among them."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).where("predicted = 0").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that pass the base rules and whose posterior is at least one half."""
    return quality_rules(docs, keep=COLUMNS).where("kept").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat a doc_id are one document: one of them stays. Rows without a doc_id stay."""
    kept = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(COLUMNS)
    return one.unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, equal texts stay equal."""
    return replace_pii(docs, KEY, keep=COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lengths are byte-level BPE tokens of the whole new texts."""
    return pack(token_counts(docs, *vocabulary()))


STAGES = [("toxicity", toxic), ("quality rules", quality), ("n-gram Jaccard join", near_copies), ("PII", personal), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
