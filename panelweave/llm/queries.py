"""The training-data operators applied to the driver's tables; each query takes (spark, sf_dir)."""

from __future__ import annotations

from panelweave.llm import chat, decontaminate, grading, html, jaccard, merkle, negatives, packing, quality, secrets, sharding, tokencount, urls
from panelweave.llm.common import modest_batches


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; executors resolve the same path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir, name):
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL contract: (verdict, host and path).
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_pack(spark, sf_dir):
    return packing.packed_digest(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_token_counts(spark, sf_dir):
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_shard(spark, sf_dir):
    return sharding.shard_digest(_table(spark, sf_dir, "documents"))


def op4_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return grading.grade_documents(docs, labels).select("doc_id", "expected_grade", "tail_probability", "kept")


def op7_secret_scan(spark, sf_dir):
    return secrets.scan_digest(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark, sf_dir):
    return html.extract_digest(_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark, sf_dir):
    return negatives.mined_digest(_table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark, sf_dir):
    return chat.chat_digest(_table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest_digest(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack,
        op2_token_counts,
        op3_shard,
        op4_jaccard,
        op5_quality_rules,
        op6_quality_classifier,
        op7_secret_scan,
        op8_url_filter,
        op9_decontaminate,
        op10_html_extract,
        op11_hard_negatives,
        op12_chat_format,
        op13_merkle_manifest,
        pipeline,
    )
}
ORACLE: dict[str, str] = {"op8_url_filter": urls.judged_sql(URL_RULES), "op11_hard_negatives": negatives.SQL, "op12_chat_format": chat.SQL, "op13_merkle_manifest": merkle.SQL}
