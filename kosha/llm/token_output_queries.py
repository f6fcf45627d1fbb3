"""Query op1: all documents as token shards in training order."""

from __future__ import annotations

from .bpe_queries import vocabulary
from .shared import table
from .token_output import sequence_digests


def op1_token_output(spark, sf_dir):
    return sequence_digests(spark, table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op1_token_output": op1_token_output}
ORACLES: dict = {}
