"""The registered queries of the operators, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_digests
from .chat import chat_windows, conversation_digests
from .common import with_row_key
from .decontaminate import find_contamination
from .exact_dedup import exact_dedup
from .merkle import document_manifest
from .mixing import mix_sources
from .near_dedup import near_dedup
from .quality import score_quality
from .sharding import assign_shards, even_tree
from .suffixes import without_repeats
from .topk import top_k
from .toxicity import score_toxicity
from .warc import archive_and_read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark, sf_dir):
    """The mix of all documents: how many words of each document it takes."""
    keyed = with_row_key(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix_sources(keyed).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_exact_dedup(spark, sf_dir):
    """Classes of documents with equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_toxicity(spark, sf_dir):
    """The toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontaminate(spark, sf_dir):
    """The benchmark items that each document contains."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark, sf_dir):
    """The quality score of every document, with its source and language as host and path."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark, sf_dir):
    """What stays of every document without the strings of 200 bytes that repeat."""
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_near_dedup(spark, sf_dir):
    """Components of documents with similar sets of shingles."""
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op8_chat(spark, sf_dir):
    """The conversations formatted in windows and read back; one more of control strings."""
    more = spark.createDataFrame(
        [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(chat_windows(rows.unionByName(more)))


def op9_warc(spark, sf_dir):
    """Pages written as archives with revisit records and read back."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return archive_and_read(table(spark, sf_dir, "pages")).select(*columns)


def op10_sharding(spark, sf_dir):
    """The shard and slot of every document among forty shards, and among one more."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(rows, even_tree(40)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_topk(spark, sf_dir):
    """The ten best candidates of every hundredth vector, by their ids."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_merkle(spark, sf_dir):
    """Leaves, roots and tried proofs of every document."""
    return document_manifest(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    """How the tokens of two tokenizers match in every document."""
    return alignment_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_exact_dedup,
        op3_toxicity,
        op4_decontaminate,
        op5_quality,
        op6_suffix_dedup,
        op7_near_dedup,
        op8_chat,
        op9_warc,
        op10_sharding,
        op11_topk,
        op12_merkle,
        op13_alignment,
    )
}
