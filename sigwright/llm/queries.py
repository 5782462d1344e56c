"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwright.llm import alignment, language, media, mixing, neardup, pieces, quality, quotes, repair, substrings, topk, toxicity, urls
from sigwright.runtime import table

#: Where the public vocabularies are installed; a parameter of the operators.
TOKENIZER = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    return pieces.encode_documents(
        table(spark, sf_dir, "documents"), tokenizer_path(), keep=("doc_id",), outputs=("n_tokens", "ids_sha256", "decoded_sha256")
    )


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, by 3-word shingles and a similarity of 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order and without quotes."""
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of all documents, with sources as hosts and their languages as paths."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat what another document keeps."""
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every embedding whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and boosted trees over the URL of every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as a media file, read back and described."""
    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media.store_texts(table(spark, sf_dir, "documents"), keep=("doc_id",), outputs=outputs)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text of documents, learnt from labels outside the held-out fold."""
    return toxicity.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every whole text of documents, learnt from lang outside the held-out fold."""
    return language.judge_documents(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of byte-level and piece tokens of every whole text of documents."""
    made = alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(), keep=("doc_id",))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, repaired by the cheapest edits."""
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), times="times")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": op1_neardup,
    "op2_quotes": op2_quotes,
    "op3_quality": op3_quality,
    "op4_substrings": op4_substrings,
    "op5_topk": op5_topk,
    "op6_mixing": op6_mixing,
    "op7_urls": op7_urls,
    "op8_media": op8_media,
    "op9_toxicity": op9_toxicity,
    "op10_pieces": op10_pieces,
    "op11_language": op11_language,
    "op12_alignment": op12_alignment,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {
    "op1_neardup": neardup.ORACLE,
    "op2_quotes": quotes.ORACLE,
    "op5_topk": topk.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op13_repair": repair.ORACLE,
}
