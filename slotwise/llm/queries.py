"""Each operator with production parameters over its whole table, by query name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.bloom_lm import score
from slotwise.llm.compression_langid import identify, learn
from slotwise.llm.decontamination import find_items, hit_words, items_digest
from slotwise.llm.fertility import judge
from slotwise.llm.filter_audit import audit, marked_failures
from slotwise.llm.jump_hash import shard_documents
from slotwise.llm.merge_dropout import encode
from slotwise.llm.pii import KINDS, pseudonymise
from slotwise.llm.randomness_secrets import KINDS as SECRET_KINDS
from slotwise.llm.randomness_secrets import find_secrets, joined
from slotwise.llm.resampling import resample
from slotwise.llm.simhash_trie import near_duplicates
from slotwise.llm.texts import held_out
from slotwise.llm.trie_bpe import encode as encode_bytes
from slotwise.llm.url_trees import Rule, host_of, longest_rule, path_of, train

#: Pseudonyms of one key link with each other only; a production run brings its own.
PII_KEY = "an example key, replace it"

URL_RULES = (
    Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document with its personal data replaced, and how much was found by kind."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY).select("doc_id", "text", *(f"pii_{k}" for k in KINDS))


def op2_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    dictionaries = learn(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), dictionaries).select(
        "doc_id", "held_out", "language.lang_pred", "language.score", "language.margin", "language.accepted")


def op3_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document."""
    judged = judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "fertility.*")


def op4_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    test = held_out(F.col("doc_id"), 7, 2)
    scored = score(docs, docs.filter(~test))
    return scored.select("doc_id", test.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; the trees learn from the URLs that a rule decides."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = longest_rule(URL_RULES, host, path)
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("by_rule"))
    # What a rule decides is labelled; a tie, as without any labels, allows.
    labelled = pages.filter("by_rule is not null").select("url", (F.col("by_rule") == "block").cast("int").alias("label"))
    scored = train(labelled).score(pages)
    judged = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", judged).alias("verdict"), "score")


def op6_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and which items these are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_items(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("found.spans"))
    return found.select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        items_digest(F.col("found.items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under merge-dropout, and whether they decode to the very text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, check="lossless")
    return coded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "lossless")


def op8_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards."""
    return shard_documents(_table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by kind and place."""
    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, SECRET_KINDS), F.sha2(joined(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(spans).alias("spans"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    classes = near_duplicates(_table(spark, sf_dir, "documents"))
    return classes.select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn toward the benchmark's words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _table(spark, sf_dir, "benchmark")).withColumnRenamed("key", "doc_id")


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and of what they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encode_bytes(docs, packed=True, back="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, per language."""
    rows = marked_failures(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    marks = {name: F.col(name) for name in ("good", "toxic")}
    return audit(rows, {letter: F.col(letter) for letter in "ABCDE"}, F.col("part"), marks, F.col("copies"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_feistel_pseudonyms, op2_compression_language, op3_token_fertility, op4_bloom_language_model, op5_url_trees,
        op6_benchmark_windows, op7_merge_dropout, op8_jump_hash_shards, op9_randomness_secrets, op10_simhash_trie,
        op11_importance_resampling, op12_trie_bpe, op13_filter_diagrams,
    )
}
