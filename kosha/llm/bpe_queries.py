"""Query op5: token ids of every document and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bpe import decode_ids, encode_texts, ids_text
from .shared import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe_round_trip(spark, sf_dir):
    path = vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return decode_ids(encode_texts(docs, path).drop("text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(ids_text("ids")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


QUERIES = {"op5_bpe_round_trip": op5_bpe_round_trip}
ORACLES: dict = {}
