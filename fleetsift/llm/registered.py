"""The registered queries of this folder, each over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .collocations import mine_collocations
from .conversations import damage, repair_conversations
from .decontamination import decontaminate
from .fingerprints import fingerprint_documents
from .licenses import scan_licenses
from .nbest import encode_n_best
from .ngram_join import similarity_components
from .oracle import SQL  # noqa: F401
from .packing import pack_documents
from .quality_classifier import score_quality, train_quality
from .quality_rules import judge_quality
from .secrets import scan_secrets
from .toxicity import score_toxicity, train_toxicity
from .url_filters import Rule, filter_urls

#: The site rules of the contract.
SITE_RULES = [Rule("org/", "allow", True), Rule("example.org/es/", "block", True), Rule("example.org/en/1", "block", True),
              Rule("com/fr/", "allow", True), Rule("com/de/", "block", True)]
#: Pattern rules for hosts and addresses that are not worth reading.
PATTERN_RULES = [Rule("||casino-", "block"), Rule("||free-bets.", "block"), Rule("||cheap-pills.", "block"), Rule("||ads-track.", "block"),
                 Rule("||spam-farm.", "block"), Rule("||adult-", "block"), Rule("||spam-farm.example.com/en/about^", "allow"),
                 Rule("/wp-login.php", "block"), Rule("/cgi-bin/", "block"), Rule("?sessionid=", "block"), Rule("|data:", "block"),
                 Rule(".exe|", "block"), Rule("/search?*q=", "block")]


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on every page's address: site rules first, then pattern rules, then allow."""
    return (filter_urls(table(spark, d, "pages").select("page_id", "url"), SITE_RULES + PATTERN_RULES)
            .select("page_id", "host", "path", "rule", "verdict", "pattern_rule"))


def op4_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """The four best segmentations of every document, and whether each decodes to it."""
    return encode_n_best(table(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op5_license_scans(spark: SparkSession, d: str) -> DataFrame:
    """Licenses that the lines and blocks of every document declare."""
    found = scan_licenses(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("units").cast("long").alias("n_units"), F.col("sized").cast("long").alias("n_sized"),
                        F.size("found").cast("long").alias("n_found"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
                        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["unit"], x["license"], x["shared"],
                                                                                x["unit_size"], x["template_size"])), ",").alias("spans"))


def op6_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Counts, compression ratios and verdicts for every document."""
    return judge_quality(table(spark, d, "documents"))


def op7_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan_secrets(table(spark, d, "documents"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document by a model fitted on labelled rows that are not held out."""
    docs = table(spark, d, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, d, "labels")))


def op2_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint_documents(table(spark, d, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles agree by 85 percent or more."""
    return similarity_components(table(spark, d, "documents"))


def op9_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return pack_documents(table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document by two co-trained views, fitted on rows that are not held out."""
    docs = table(spark, d, "documents")
    return score_quality(docs, train_quality(docs, table(spark, d, "labels")))


def op11_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    """The 2000 phrases of each language whose words stay together most."""
    return mine_collocations(table(spark, d, "documents"))


def op12_conversation_structure_repair(spark: SparkSession, d: str) -> DataFrame:
    """Faults of every damaged conversation, the cheapest edits that mend it, and what they give."""
    return repair_conversations(damage(table(spark, d, "conversations")))[0].withColumnRenamed("conv", "conv_id")


def op13_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document inside ten-word windows of the benchmark, and the items they come from."""
    return decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_document_fingerprints, op3_ngram_jaccard_join, op4_sentencepiece,
                                   op5_license_scans, op6_quality_rules, op7_secret_scans, op8_toxicity, op9_best_fit_packing, op10_quality_classifier, op11_phrase_collocations, op12_conversation_structure_repair,
                                   op13_benchmark_decontamination)}
