"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lorikeet.llm.alignment import op11_alignment
from lorikeet.llm.chat import OP5_SQL, op5_chat
from lorikeet.llm.common import read
from lorikeet.llm.cuckoo import OP12_SQL, op12_exact_dedup
from lorikeet.llm.embedding_dedup import OP8_SQL, op8_embeddings
from lorikeet.llm.infill import OP13_SQL, op13_infill
from lorikeet.llm.mixing import OP2_SQL, op2_mix
from lorikeet.llm.multiset_hash import op4_fingerprint
from lorikeet.llm.packing import op3_pack
from lorikeet.llm.pii import op10_pii
from lorikeet.llm.sharding import op6_shard
from lorikeet.llm.simhash import op1_simhash
from lorikeet.llm.toxicity import op7_toxicity
from lorikeet.llm.warc import OP9_SQL, op9_warc
from lorikeet.session import ship


def _over(table: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(read(ship(spark), sf_dir, table))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_toxicity(read(ship(spark), sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _over("documents", op1_simhash),
        "op2_mix": _over("documents", op2_mix),
        "op3_pack": _over("documents", op3_pack),
        "op4_fingerprint": _over("documents", op4_fingerprint),
        "op5_chat": _over("conversations", op5_chat),
        "op6_shard": _over("documents", op6_shard),
        "op7_toxicity": _op7,
        "op8_embeddings": _over("embeddings", op8_embeddings),
        "op9_warc": _over("pages", op9_warc),
        "op10_pii": _over("documents", op10_pii),
        "op11_alignment": _over("documents", op11_alignment),
        "op12_exact_dedup": _over("documents", op12_exact_dedup),
        "op13_infill": _over("documents", op13_infill),
        "pipeline": lambda spark, sf_dir: corpus_pipeline.run(ship(spark), sf_dir),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": OP2_SQL, "op5_chat": OP5_SQL, "op8_embeddings": OP8_SQL, "op9_warc": OP9_SQL, "op12_exact_dedup": OP12_SQL, "op13_infill": OP13_SQL}
