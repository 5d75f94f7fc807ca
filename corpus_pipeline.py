"""A training-corpus pipeline over the documents table: identify, deduplicate, decontaminate, mask, pack.

Each stage takes (spark, docs, sf_dir) and works on every document that the stage before
it kept. All but the last return the columns of documents. A stage's result is written as
Parquet and read again as the next one's docs. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, langid, neardup, packing, pii
from orrery.llm import textops as T
from orrery.llm.queries import tokenizer_file
from orrery.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Cosine below which a text of MIN_LETTERS or more is like no language. Texts in scripts that no
#: prototype knows reach 0.12, four standard deviations of independent vectors; the least of
#: 61,000 labelled documents with so many letters had 0.135. Shorter texts hold too few
#: trigrams to tell (0.04 and more) and stay.
MIN_SCORE, MIN_LETTERS = 0.125, 64


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language. Null texts, texts without letters and texts
    of MIN_LETTERS like no language go; `lang` keeps its value, or gets the prediction
    where it is null."""
    model = langid.fit(docs)
    found = langid.predict(docs.select(*COLUMNS), model, keep=COLUMNS)
    known = found.where((F.col("lang_pred") != "und") & ((F.col("score") >= MIN_SCORE) | (F.col("letters") < MIN_LETTERS)))
    return T.stored(known.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the
    least doc_id. Of rows with the same doc_id the one with the least text (then lang, source,
    n_chars) stays; rows with a null doc_id stay."""
    found = neardup.near_duplicates(docs, neardup.NearDup(size=5, percent=80))
    kept = T.stored(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")))
    # the ids compress well on disk, so their size there is no bound for a broadcast
    out = docs.select(*COLUMNS).join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    twice = kept.where("rows > 1").select("doc_id").hint("merge")
    if not twice.isEmpty():
        one = F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")
        first = out.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("doc_id", "r.*")
        out = out.join(twice, "doc_id", "left_anti").select(*COLUMNS).unionByName(first)
    return out.unionByName(docs.select(*COLUMNS).where("doc_id is null")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return T.stored(decontam.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    found = pii.detect(docs, masked=True, keep=("lang", "source"))
    return T.stored(found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("long").alias("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, packing.Packing(tokenizer_file("word_bpe_49k.json"), length=4096, end_id=1))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("pack", pack_sequences),
]

#: No stage but the third's and fourth's filters could be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1 and not T.is_stored(docs):
            docs = T.stored(docs)
        if T.is_stored(before) and T.is_stored(docs):
            T.discard(before)
    return docs
