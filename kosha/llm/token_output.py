"""Token output in training order: binary shards of fixed stride for sequential, resumable reads.

Texts are encoded, laid end to end in a stream and cut into sequences of equal
length.  A keyed Feistel permutation over the number of sequences, cycle-walking
where its domain is larger, gives every sequence its slot in training order;
slots are partitioned by ranges of shards, and slot s stands at a place that
arithmetic gives: shard s div sequences-per-shard, offset (s mod that) * stride.
Tokens are compressed wherever they wait for the next step.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import load
from .shared import broadcast_if_small, keep, scratch
from .shingles import mix

LENGTH = 1024  # tokens of a sequence
SHARD = 4096  # sequences of a shard
SHARDS_A_TASK = 4
BLOCK = 1 << 16  # tokens of the stream in one row
ROUNDS = 6
END = "<|endoftext|>"  # token after each text and filler of the last sequence


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of indices below n: a Feistel network on pairs of digits, walked until the value is below n."""
    side = int(np.ceil(np.sqrt(n)))
    side += side * side < n
    m = np.uint64(side)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // m, out[todo] % m
        for r in range(ROUNDS):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F + 1) & (2**64 - 1))
            left, right = right, (left + mix(right + salt) % m) % m
        out[todo] = left * m + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def invert(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The indices whose slots are given."""
    side = int(np.ceil(np.sqrt(n)))
    side += side * side < n
    m = np.uint64(side)
    out = slot.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // m, out[todo] % m
        for r in reversed(range(ROUNDS)):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F + 1) & (2**64 - 1))
            left, right = (right + m - mix(left + salt) % m) % m, left
        out[todo] = left * m + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def token_stream(docs: DataFrame, path: str, text_col: str, end: str = END) -> DataFrame:
    """part (the task that read the texts), at (its tokens before), n and tokens (binary) of every block of the stream, an end token after each text."""

    def run(batches):
        codec, part, at = load(path), TaskContext.get().partitionId(), 0
        stop, block = codec.type.type(codec.special[end]).tobytes(), BLOCK * codec.type.itemsize
        held = b""

        def out(data):
            nonlocal at
            pieces = [data[i : i + block] for i in range(0, len(data), block)]
            n = np.array([len(x) // codec.type.itemsize for x in pieces], dtype=np.int64)
            places = at + np.cumsum(n) - n
            at += int(n.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(places), pa.array(n), pa.array(pieces, pa.binary())], names=["part", "at", "n", "tokens"])

        for b in batches:
            for some in codec.encode_column(b.column(0)):
                held += b"".join([x.tobytes() + stop for x in some])
                whole = len(held) // block * block
                if whole:
                    yield out(held[:whole])
                    held = held[whole:]
        if held:
            yield out(held)

    return docs.select(text_col).mapInArrow(run, "part int, at long, n long, tokens binary")


def cut(stream: DataFrame, total: int, length: int, key: int, kind: np.dtype) -> DataFrame:
    """(slot, at, tokens): the stream cut at the bounds of sequences; at is the place within one, tokens are compressed."""
    sums = stream.groupBy("part").agg(F.sum("n").alias("k"))
    # One row for each task that read the input, so this window is as small as a list of tasks.
    starts = keep(sums.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("start")), "starts")
    placed = stream.join(broadcast_if_small(starts), "part").select((F.col("start") + F.col("at")).alias("start"), "tokens")
    count, size = -(-total // length), kind.itemsize

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for s, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = t.as_buffer().to_pybytes()
                end = s + len(data) // size
                bounds = [s, *range((s // length + 1) * length, end, length), end]
                slots = permute(np.arange(s // length, (end - 1) // length + 1), count, key)
                at = np.array(bounds[:-1]) % length
                parts = [packer.compress(data[size * (low - s) : size * (high - s)]) for low, high in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(at.astype(np.int32)), pa.array(parts, pa.binary())], names=["slot", "at", "tokens"])

    return placed.mapInArrow(run, "slot long, at int, tokens binary")


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:08d}.bin"


def claim(folder: str, plan: dict) -> None:
    """Write the plan of a folder, or check that the one it has is the same."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    if store.get_file_info(f"{root}/plan.json").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/plan.json") as f:
            there = json.loads(f.read())
        if there != plan:
            raise ValueError(f"{folder} has another plan: {', '.join(k for k in plan if there.get(k) != plan[k])} differ")
        return
    with store.open_output_stream(f"{root}/plan.json.new") as f:
        f.write(json.dumps(plan).encode())
    store.move(f"{root}/plan.json.new", f"{root}/plan.json")


def write_shards(docs: DataFrame, path: str, folder: str, text_col: str = "text", length: int = LENGTH, per_shard: int = SHARD, key: int = 1, end: str = END) -> int:
    """Write docs to shards and index.json in folder, a URI that all executors reach; return the number of sequences.

    Ids take two bytes, or four if the vocabulary has more than 65,536.  Each task
    writes a range of slots, shard by shard; a shard is written under a name of
    its own, then renamed, and one that already stands in full is left, so a job
    that was cut short goes on where it was.  plan.json, which is written before
    any shard, tells the vocabulary, the parameters and a digest of the stream; a
    folder that has another plan is refused.  Null and empty texts are an end
    token each; repeated rows are written as often as they stand.  The last sequence is filled with end
    tokens.  Without rows there are no shards.  Other columns play no part.
    """
    codec = load(path)
    kind, filler = codec.type, codec.special[end]
    stream = keep(token_stream(docs, path, text_col, end), "tokens", "zstd")
    sums = stream.agg(F.sum("n").alias("n"), F.bit_xor(F.xxhash64("part", "at", "n", "tokens")).alias("digest")).first()
    total = sums["n"] or 0
    count = -(-total // length)
    with open(path, "rb") as f:
        vocabulary = hashlib.sha256(f.read()).hexdigest()
    claim(folder, {"vocabulary": vocabulary, "end": filler, "length": length, "per_shard": per_shard, "key": key, "tokens": total, "stream": sums["digest"]})
    shards = -(-count // per_shard)
    rows = cut(stream, total, length, key, kind).withColumn("shard", F.expr(f"slot div {per_shard}"))
    rows = rows.repartitionById(max(1, -(-shards // SHARDS_A_TASK)), F.expr(f"cast(shard div {SHARDS_A_TASK} as int)")).sortWithinPartitions("slot", "at")
    stride = length * kind.itemsize
    last = int(permute(np.array([count - 1]), count, key)[0]) if count else -1

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, unpacker = TaskContext.get(), zstandard.ZstdDecompressor()
        suffix = f".{context.partitionId()}-{context.taskAttemptId()}"
        out, done, slot, filled = None, None, -1, 0
        written = []

        def fill():
            nonlocal filled
            if out is not None and slot >= 0 and filled < stride:
                if slot != last:
                    raise ValueError(f"slot {slot} lacks tokens")
                out.write(np.full((stride - filled) // kind.itemsize, filler, kind).tobytes())
            filled = 0

        def close():
            nonlocal out
            if out is not None:
                fill()
                out.close()
                store.move(shard_path(root, done) + suffix, shard_path(root, done))
                out = None

        for b in batches:
            for q, s, t in zip(b.column("shard").to_pylist(), b.column("slot").to_pylist(), b.column("tokens"), strict=True):
                if q != done:
                    close()
                    done, slot = q, -1
                    size = min(per_shard, count - q * per_shard) * stride
                    there = store.get_file_info(shard_path(root, q))
                    if there.type != fs.FileType.File or there.size != size:
                        out = store.open_output_stream(shard_path(root, q) + suffix, compression=None)
                    written.append(q)
                if s != slot:
                    fill()
                    slot = s
                if out is not None:
                    data = unpacker.decompress(t.as_buffer())
                    out.write(data)
                    filled += len(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.int64())], names=["shard"])

    if keep(rows.select("shard", "slot", "tokens").mapInArrow(run, "shard long"), "shards").count() != shards:
        raise RuntimeError("shards are missing")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/index.json") as f:
        f.write(json.dumps({"sequences": count, "tokens": total, "length": length, "width": kind.itemsize, "per_shard": per_shard, "key": key, "end": filler}).encode())
    return count


def read_index(folder: str) -> dict:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/index.json") as f:
        return json.loads(f.read())


def read_slots(spark: SparkSession, folder: str, first: int = 0) -> DataFrame:
    """(slot, sequence, shard, byte_offset, tokens as binary) from slot `first` on, read in order within each shard."""
    index = read_index(folder)
    count, per, stride, key = index["sequences"], index["per_shard"], index["length"] * index["width"], index["key"]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for shard in b.column(0).to_pylist():
                low, high = max(first, shard * per), min(count, (shard + 1) * per)
                with store.open_input_file(shard_path(root, shard)) as f:
                    f.seek((low - shard * per) * stride)
                    for at in range(low, high, 512):
                        slots = np.arange(at, min(at + 512, high))
                        data = f.read(len(slots) * stride)
                        if len(data) != len(slots) * stride:
                            raise ValueError(f"shard {shard} is cut short")
                        rows = [data[k * stride : (k + 1) * stride] for k in range(len(slots))]
                        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(invert(slots, count, key)), pa.array(np.full(len(slots), shard)), pa.array((slots - shard * per) * stride), pa.array(rows, pa.binary())], names=["slot", "sequence", "shard", "byte_offset", "tokens"])

    shards = -(-count // per)
    start = min(first // per, shards)
    return spark.range(start, shards, 1, max(1, shards - start)).mapInArrow(run, "slot long, sequence long, shard long, byte_offset long, tokens binary")


def sequence_digests(spark: SparkSession, docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH, per_shard: int = SHARD, key: int = 1) -> DataFrame:
    """Write docs and read them back: slot, sequence, shard, byte_offset, n_tokens and tokens_sha256 of every sequence.

    n_tokens leaves the filler of the last sequence out.  Null and empty texts
    give an end token each, repeated rows stand as often as they are given, very
    long texts span as many sequences as they need, and an empty table gives an
    empty result; other columns play no part.
    """
    folder = scratch(spark) + "/shards"
    write_shards(docs, path, folder, text_col, length, per_shard, key)
    index = read_index(folder)
    n = F.least(F.lit(length), F.lit(index["tokens"]) - F.col("sequence") * length)
    return read_slots(spark, folder).select("slot", "sequence", "shard", "byte_offset", n.cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("tokens_sha256"))
