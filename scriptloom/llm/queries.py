"""The registered queries of this subpackage: op1 to op13, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, filter_audit, jaccard_join, langid, license_scan, media, mixing, packing, substring_dedup, suffix_dedup, token_output
from .common import documents, stored


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of license notices in every document; the operator's spans are left out."""
    return license_scan.license_scan(documents(spark, sf_dir)).drop("spans")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word sets are similar by 0.9 or more."""
    return jaccard_join.jaccard_join(documents(spark, sf_dir), words=3, per_cent=90)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture, sources weighed by the square root of their documents."""
    return mixing.mix(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings of 400 bytes that stand elsewhere too."""
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), with_kept=False)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids, read back from the written blocks."""
    return token_output.read_tokens(token_output.write_tokens(documents(spark, sf_dir)), with_ids=False)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 ids."""
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without windows of 13 words that a smaller id has."""
    return substring_dedup.substring_dedup(documents(spark, sf_dir), with_kept=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from two thirds of the labelled ones."""
    docs = documents(spark, sf_dir)
    fold = langid.held_out()
    counts = langid.learn(docs.filter(~fold))
    found = langid.identify(docs.select("doc_id", fold.alias("held_out"), "text"), counts, keep=["doc_id", "held_out"])
    return found


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each text stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the stored audio of every document, written and read back."""
    written = stored(media.store_text_audio(documents(spark, sf_dir)))
    return media.audio_digests(written)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir)))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    return filter_audit.filter_audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers in every document."""
    return alignment.align(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_jaccard_join,
        op3_mixing,
        op4_suffix_dedup,
        op5_token_output,
        op6_packing,
        op7_substring_dedup,
        op8_language_id,
        op9_exact_dedup,
        op10_media,
        op11_bpe,
        op12_filter_audit,
        op13_alignment,
    )
}

ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
