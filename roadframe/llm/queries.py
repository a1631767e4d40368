"""The registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers as P

from roadframe.llm import alignment, bpe, chat, exact, html, neardup, packing, passages, pii, quality, sharding, twins, versions, whitening
from roadframe.llm.common import read

QUERIES: dict = {}
ORACLES = {"op1_exact_dedup": twins.EXACT, "op2_quality": twins.QUALITY, "op6_chat": twins.CHAT, "op8_minhash": twins.NEAR}

def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark, sf_dir):
    return exact.exact_groups(read(spark, sf_dir, "documents"))


@query
def op7_pii(spark, sf_dir):
    return pii.find_personal_data(read(spark, sf_dir, "documents")).drop("redacted")


@query
def op9_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@query
def op10_bpe(spark, sf_dir):
    return bpe.encode_texts(read(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=False)


@query
def op2_quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents")).drop("posterior")


@query
def op5_sharding(spark, sf_dir):
    return sharding.shard(read(spark, sf_dir, "documents"))


@query
def op6_chat(spark, sf_dir):
    return chat.rotate_perspectives(read(spark, sf_dir, "conversations"))


@query
def op8_minhash(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_html(spark, sf_dir):
    return html.main_text(read(spark, sf_dir, "pages"))


@query
def op4_passages(spark, sf_dir):
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


@query
def op11_fingerprints(spark, sf_dir):
    return versions.half_edit_report(read(spark, sf_dir, "documents"))


@query
def op12_alignment(spark, sf_dir):
    return alignment.align_tokens(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN,
                                  P.path("piece_bpe_32k.model"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))
