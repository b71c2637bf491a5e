"""A corpus pipeline over the columns of `documents`: language ID, near duplicates, repeated passages, benchmark hits, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it back for the next stage. A stage's result is written before the next stage is called: what it reads in the shared folder
is deleted then, unless the next stage's docs still read it. Other columns travel through the operators as one struct beside doc_id and text, so
they, whatever their names, repeated rows and nulls come out as they went in; n_chars follows a rewritten text.

Defined results: a null text has no letters (dropped by the first stage), links with nothing, loses nothing, is not
contaminated and packs as its end id. Empty tables stay empty.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm import decontaminate, langid, ngram_join, packing, suffix_dedup
from lodespark.llm.common import Scratch, bounded_batches, delete, reads, recorded, release, table
from lodespark.llm.queries import tokenizer

#: DuckDB SQL for run()'s rows: none, as packing and language ID have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


#: For each stage that ran, the paths its result reads.
_left: list[list[str]] = []


def _stage(f):
    """Deletes what earlier stages have left, and notes what this one leaves."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        done = [paths for paths in _left if not any(reads(docs, p) for p in paths)]
        _left[:] = [paths for paths in _left if paths not in done]
        for path in (p for paths in done for p in paths):
            delete(spark, path)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left.append(paths)
        release()  # what the driver's Python has freed (fitting language models: half of its memory) stands beside the JVM else
        return out

    return run


def _boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one."""
    bounded_batches(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(None).cast("int").alias("_")])).alias("_doc"))


def _unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, in their order and types."""
    own = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(f"_doc.`{c}`")
    return rows.select(*(own(f.name).cast(f.dataType).alias(f.name) for f in docs.schema))


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language models reject: no letters, or a cross-entropy far above their language's own.

    Models are learnt from the labelled rows of `docs` itself; without any, only texts without a letter go."""
    models = langid.fit(docs.select("doc_id", "text", "lang"))
    if not models.names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _unboxed(langid.identify(_boxed(docs), models).where(~F.col("lang_rejected")), docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows that repeat a doc_id and its text are one document: the one with the smallest hash of the whole row stays. Rows that share a doc_id but not
    a text are documents of their own. Rows without an id, or without words, stay."""
    bounded_batches(spark)
    key = ["doc_id", "text_hash"]
    found = ngram_join.link_components(docs.select("doc_id", "text"), k=5, percent=80).where("doc_id is not null and component is not null")
    rows = found.groupBy(*key, "component", "component_id").agg(F.count("*").alias("copies"))
    heads = rows.where("doc_id = component_id").groupBy("component").agg(F.min_by(F.struct(*key, "copies"), F.struct(*key)).alias("h")).select("h.*")
    with Scratch(spark) as own:
        heads = own.result(heads, "heads")
        gone = own.result(rows.join(heads, key, "left_anti").select(*key), "gone")
    boxed = _boxed(docs).withColumn("_hash", F.xxhash64("text"))
    of = lambda t: t.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    same = (F.col("doc_id").cast("long") == F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash"))
    few = gone.count() <= ngram_join.BROADCAST_ROWS
    out = boxed.join(F.broadcast(of(gone)) if few else of(gone), same, "left_anti")
    again = of(heads.where("copies > 1"))
    if not again.isEmpty():
        row = F.struct("doc_id", "text", "_doc")
        once = out.join(again, same, "left_semi").groupBy("doc_id", "_hash").agg(F.min_by(row, F.xxhash64(row)).alias("r")).select("r.*", "_hash")
        out = out.join(again, same, "left_anti").unionByName(once)
    return _unboxed(out, docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that also start earlier. A character cut in half goes whole; a document of which nothing but white space is left goes."""
    rows = suffix_dedup.remove_repeats(_boxed(docs), length=100, as_text=True)
    cut = F.size("removed") > 0
    rows = rows.where(~cut | F.col("kept").rlike(r"[^\x00-\x20]"))
    rows = rows.withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("_doc", F.col("_doc").withField("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))))
    return _unboxed(rows, docs)


@_stage
def benchmark_hits(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lie in windows of benchmark items."""
    hits = decontaminate.find_contamination(_boxed(docs), table(spark, sf_dir, "benchmark"))
    return _unboxed(hits.where(~decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))), docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row for each piece."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=1, size=2048)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_hits),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as own:
        for name, stage in STAGES[:-1]:
            before, docs = docs, own.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            own.drop(before)
        return STAGES[-1][1](spark, docs, sf_dir)  # reads its own tables only
