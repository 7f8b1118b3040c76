"""The training-corpus pipeline: stages over documents, each written as Parquet and read again for the next.

Stages but the last return the columns of documents. A document without text or with a null column passes each stage
like an empty one; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.llm import _shared as S, jaccard, mixing, packing, suffix, toxicity
from siltmark.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels, keep=list(COLUMNS)).filter("rejected = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest row, by doc_id and then text, of each component of near-duplicates; equal doc_id with other text is another row."""
    root = S.shared_root(spark)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = docs.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    rows = S.materialised(once.select("doc_id", "text", "rest.*").withColumn("row", F.monotonically_increasing_id()), f"{root}/rows")
    found = jaccard.similar(rows.select("row", "text"), key="row").select("row", "component_id")
    keys = rows.select("row", "doc_id", F.sha2("text", 256).alias("digest"))
    kept = found.join(keys, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "row")).alias("least")).select(F.col("least.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start twice in the corpus; documents of which nothing is left go."""
    rows = suffix.remove_repeats(docs, keep=["lang", "source"])
    kept = rows.filter("n_removed = 0 or length(trim(kept_text)) > 0")
    text = F.when((F.col("n_bytes") == 0), F.lit("")).otherwise(F.col("kept_text"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix by sources takes it; one that a full source has no room for goes."""
    root = S.shared_root(spark)
    sized = docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("sources", F.array(F.col("source").cast("string")))
    plan = mixing.plan_mix(S.materialised(sized.select("doc_id", "size", "sources"), f"{root}/sized"), root, "doc_id", mixing.repeating_weights)
    taken = mixing.apply_mix(sized, plan, "doc_id")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier and packing are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the last stage's rows."""
    root = S.shared_root(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = S.materialised(stage(spark, docs, sf_dir), f"{root}/stage{k}")
    return docs
