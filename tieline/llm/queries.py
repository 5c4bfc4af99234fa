"""One registered query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tieline.llm import bpe, chat, html_text, licenses, packing, pseudonyms, quality, repetitions, sharding, simhash, token_files, topk, whitening
from tieline.llm.common import table
from tieline.session import work_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: For the registered query alone; real keys come from the caller's secret store.
DEMO_KEY = "demonstration key"


def op1_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_pii(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op3_chat(spark, sf_dir):
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_licenses(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    path = work_dir(spark, "token-files")
    token_files.write_shards(table(spark, sf_dir, "documents"), path, TOKENIZER)
    return token_files.read_documents(spark, path)


def op8_topk(spark, sf_dir):
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_bpe(spark, sf_dir):
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), RANKS)


def op10_html(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op11_shards(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op12_runs(spark, sf_dir):
    return repetitions.run_digests(repetitions.repetitions(repetitions.plant_periods(table(spark, sf_dir, "documents"))))


def op13_whiten(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_pack, op2_pii, op3_chat, op4_simhash, op5_quality, op6_licenses, op7_token_files, op8_topk, op9_bpe, op10_html,
    op11_shards, op12_runs, op13_whiten,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op3_chat": chat.SQL, "op8_topk": topk.SQL}
