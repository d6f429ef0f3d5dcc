"""A corpus from documents to packed sequences: quality, near-duplicates, secrets, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept.
All but the last return the columns of their input. Null texts and empty tables pass
through every stage; columns beyond those of ``documents`` are carried along under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import Workspace
from cuegrid.llm.minhash import near_duplicates
from cuegrid.llm.mixing import mix_sources, repeated
from cuegrid.llm.packing import pack
from cuegrid.llm.quality import assess, corpus_bands, within_corpus
from cuegrid.llm.queries import tokenizer_file
from cuegrid.llm.secrets import find_secrets

BASE = ("doc_id", "text", "lang", "source", "n_chars")
MASK = "[SECRET]"


def _plain(docs: DataFrame) -> DataFrame:
    """Extra columns under neutral names, so that none clashes with an operator's own."""
    return docs.toDF(*[c if c in BASE else f"extra{i}" for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules reject go.

    Null and empty texts have no words and are rejected; so is a short text. Repeated rows
    and rows without doc_id or language are judged each by itself; a figure equal to a limit
    is within it. Very long texts are measured whole. An empty table gives no rows.

    The texts are read twice, for the bands and for the verdict, and never written in between.
    """
    plain, vocabulary = _plain(docs), tokenizer_file("piece_bpe_32k.model")
    bands = Workspace(spark, "quality").save(corpus_bands(assess(plain, vocabulary, keep=[c for c in plain.columns if c == "lang"])), "bands")
    judged = within_corpus(assess(plain, vocabulary, keep=plain.columns), bands)
    return judged.where("kept").select(plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarities of 0.8 or more one document stays, that with the least doc_id.

    Rows of one doc_id and equal text are one document: the first by the other columns
    stays, whatever their source or language. Rows that share a doc_id but not their text
    are judged one by one. Rows without doc_id all stay, as do null and empty texts; of
    equally similar texts no choice is needed, as the least doc_id decides. Very long texts
    are compared whole. An empty table gives no rows.
    """
    ws = Workspace(spark, "dedup")
    plain = _plain(docs)
    names, text_key = plain.columns, F.unhex(F.sha2("text", 256))
    gone = near_duplicates(plain.withColumn("text_key", text_key), percent=80, keep=("text_key",)).where("not kept").select("doc_id", "text_key").distinct()
    gone = ws.save(gone, "gone")
    repeats = ws.save(plain.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats")
    if repeats.isEmpty():
        return plain.join(gone, "doc_id", "left_anti").select(names).toDF(*docs.columns)
    single = plain.join(repeats, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(names)
    shared = plain.join(repeats, "doc_id", "left_semi").withColumn("text_key", text_key)
    rest = [c for c in names if c not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", "text_key").orderBy(*(rest or ["doc_id"]))
    shared = shared.withColumn("place", F.row_number().over(order)).where("place = 1")
    unlike = shared.join(gone, ["doc_id", "text_key"], "left_anti").select(names)
    return single.unionByName(unlike).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; the document stays.

    Null and empty texts stay as they are. Spans that overlap get one mask. Rows are
    handled each by itself, whatever their ids; very long texts are scanned whole. An empty
    table gives no rows.
    """
    plain = _plain(docs)
    others = [c for c in plain.columns if c != "text"]
    found = find_secrets(plain, keep=others, mask=MASK)
    changed = F.size("_spans") > 0
    columns = {"text": F.col("_clean")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[columns.get(c, F.col(c)).alias(c) for c in plain.columns]).toDF(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, sampled and cut so that sources meet their targets.

    Null and empty texts have no words and are not taken. A null source is a source of its
    own. Repeated rows each count; which of equal rows is sampled does not show. A very long
    text is cut, if at all, between words. An empty table gives no rows.
    """
    plain = _plain(docs)
    return repeated(mix_sources(plain, keep=plain.columns), plain.columns).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, their sequence and their place in it: what a training run reads.

    A null or empty text is a piece of the end mark alone. Repeated rows and rows without
    doc_id are packed each by itself; which of equally long pieces goes where is fixed by
    doc_id and piece. Very long texts become as many pieces as they need. An empty table
    gives no rows.
    """
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisers and seeded samples are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; a table goes when the next is written."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done: list[str] = []
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.drop(*done)
        done = [name]
    return docs
