"""From raw documents to a mixed, sharded corpus, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from graphloom.llm.common import WORD, columns, stored
from graphloom.llm.exact_dedup import sized

SHARDS = 40
#: Decisions of at most so many rows are broadcast.
FEW = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, trained on those of docs that have a label.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty. Without labels of both
    kinds all rows stay.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at 0.8 or more over five-word shingles.

    Rows are decided one by one, whatever keys repeat: of a group, the row of the smallest doc_id stays (null is last; then
    by a hash of the row). Rows of one text are a group, also under one doc_id; texts that link with nothing stay, as do
    all rows without a word. An empty table stays empty. Columns of any name stay as they are, but for names that start
    with __dup_.
    """
    text = F.xxhash64("text")
    found = jaccard_join.groups(docs.select(text.alias("doc_id"), "text")).filter("n_shingles > 0")
    texts = stored(found.groupBy(F.col("id").alias("__dup_h"), F.col("component_id").alias("__dup_g")).agg(F.count("*").alias("n")))
    several = stored(texts.groupBy("__dup_g").agg(F.sum("n").alias("n")).filter("n > 1").select("__dup_g"))
    linked = stored(texts.select("__dup_h", "__dup_g").join(sized(several, FEW), "__dup_g"))
    row = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns(docs), docs.schema, strict=True)]).alias("hash"))
    marked = docs.withColumns({"__dup_h": text, "__dup_k": row}).join(sized(linked, FEW), "__dup_h", "left")
    keys = marked.filter("__dup_g IS NOT NULL").groupBy("__dup_g", "__dup_k").agg(F.count("*").alias("__dup_n"))
    first = stored(keys.groupBy("__dup_g").agg(F.min(F.struct("__dup_k", "__dup_n")).alias("__dup_f")))
    kept = marked.join(sized(first, FEW), "__dup_g", "left").filter("__dup_g IS NULL OR __dup_k <=> __dup_f.__dup_k")
    if first.filter("__dup_f.__dup_n > 1").limit(1).count():  # rows that are equal in all columns
        twin = F.coalesce(F.col("__dup_f.__dup_n") > 1, F.lit(False))
        return kept.filter(~twin).select(columns(docs)).unionAll(kept.filter(twin).dropDuplicates(["__dup_g"]).select(columns(docs)))
    return kept.select(columns(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and short texts stay; repeated rows stay or go together; with an empty benchmark all rows stay.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for; documents with no copy are left out.

    Null doc_ids and sources are values like any other; a null or empty text has size 0. Of rows that repeat doc_id, text and
    source, some may get a copy more than the others. An empty table stays empty. Columns of any name stay as they are, but for
    names that start with __mix_.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    marked = docs.withColumns({"__mix_id": F.xxhash64("doc_id", "text"), "__mix_size": size})
    rows = stored(marked.select(F.col("__mix_id").alias("id"), "source", F.col("__mix_size").alias("size")))
    key = [F.col("id").alias("__mix_i"), F.col("source").alias("__mix_s"), F.col("size").alias("__mix_z")]
    low = mixing.copies(rows).groupBy(*key).agg(F.min("copies").alias("__mix_low"), F.max("copies").alias("__mix_top"), F.sum("n").alias("__mix_n"), F.max_by("n", "copies").alias("__mix_up"))
    decided = stored(low.filter("__mix_top > 0"))
    met = (F.col("__mix_id") == F.col("__mix_i")) & F.col("source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_size") == F.col("__mix_z"))
    dealt = marked.join(sized(decided, FEW), met)
    alike = F.row_number().over(Window.partitionBy("__mix_i", "__mix_s", "__mix_z").orderBy("doc_id"))
    # the few rows that are alike and do not all get as many copies are numbered
    one = dealt.filter("__mix_low = __mix_top").withColumn("__mix_c", F.col("__mix_top"))
    more = dealt.filter("__mix_low < __mix_top").withColumn("__mix_c", F.when(alike <= F.col("__mix_up"), F.col("__mix_top")).otherwise(F.col("__mix_low")))
    both = one.unionByName(more).filter("__mix_c > 0")
    return both.withColumn("__mix_c", F.explode(F.sequence(F.lit(1), "__mix_c"))).select(columns(docs))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and a gapless slot in it.

    Null doc_ids are one key; repeated rows are numbered in any order; an empty table stays empty. Columns named shard and
    slot are replaced; all others stay, but for names that start with __slot_.
    """
    crc = "__slot_crc"
    rows = sharding.assign(docs, "doc_id", [1.0] * SHARDS).withColumn(crc, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sharding.number(rows, "shard", ["doc_id", crc]).drop(crc)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained models and seeded rounding are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
