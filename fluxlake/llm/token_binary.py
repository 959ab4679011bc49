"""Token ids in files, bit-packed at a fixed width.

A folder holds shards in ascending order of document id. A shard is a sequence of blocks, each one row of a Parquet file
with its place (``shard, block, first``: ids of the shard before it), the ids of its documents, their offsets in the
block, and the payload: every token id in the least number of bits that the vocabulary needs, id ``i`` at bit
``i * bits``. So any range of ids is found by a filter on ``shard`` and ``first`` and unpacked by numpy, without
decoding what lies before it. Parquet is the container because Spark's committer then writes the files: they reach any store, and
a lost or repeated task leaves no half-written shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlake.llm.bpe import ChunkEncoder, byte_of, default_tokenizer
from fluxlake.llm.common import documents, parts_for
from fluxlake.session import fresh_path

# Ids after which a block is closed (documents are never split), and documents that a shard should hold.
BLOCK_IDS = 1 << 16
SHARD_DOCUMENTS = 16_384
END_ID = 0
# Words that each generation of a worker's memory holds.
WORDS_KEPT = 1 << 19


def width(vocab_size: int) -> int:
    """Bits that every id below ``vocab_size`` fits in."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, lowest bit first, padded to whole bytes."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and bits < 32 and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, :bits // 8].tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a payload, touching only their own bytes."""
    raw = np.frombuffer(payload, np.uint8)
    if bits % 8 == 0:
        size = bits // 8
        out = np.zeros((stop - start, 4), np.uint8)
        out[:, :size] = raw[start * size:stop * size].reshape(-1, size)
        return out.view("<u4").ravel()
    low = start * bits // 8
    planes = np.unpackbits(raw[low:-(-stop * bits // 8)], bitorder="little")[start * bits - low * 8:][:(stop - start) * bits]
    return planes.reshape(-1, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


_WORKER: dict[str, tuple[ChunkEncoder, int]] = {}


def library_encoder(path: str) -> tuple[ChunkEncoder, int]:
    """The tokenizers library's encoding of whole texts, and the vocabulary's size; made once in each worker.

    The library's BPE model encodes each distinct pre-token; what it gave is remembered, as words repeat.
    """
    if path not in _WORKER:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        char = {byte: c for c, byte in byte_of().items()}
        model, table = tokenizer.model, {b: char[b] for b in range(256)}
        spelled = lambda piece: piece.encode().decode("latin-1").translate(table)
        added = {token.content: number for number, token in tokenizer.get_added_tokens_decoder().items()}
        _WORKER[path] = ChunkEncoder(lambda piece: [token.id for token in model.tokenize(spelled(piece))], added, WORDS_KEPT), tokenizer.get_vocab_size()
    return _WORKER[path]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the ids below ``folder`` in ascending order of id.

    NULL and empty texts hold the end id alone. NULL ids come first; rows with equal ids follow each other in the order
    of their texts. An empty table writes no block. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard int, block int, first bigint, bits int, n_ids int, doc_ids array<{kind}>, offsets array<int>, payload binary"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, vocab_size = library_encoder(tokenizer)
        bits, end = width(vocab_size), np.array([end_id], "<u4").tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names: list = []
        parts: list[bytes] = []
        held = 0

        def close() -> pd.DataFrame:
            nonlocal block, first, held
            offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = (shard, block, first, bits, len(ids), list(names), offsets.tolist(), pack(ids, bits))
            block, first, held = block + 1, first + len(ids), 0
            names.clear()
            parts.clear()
            return pd.DataFrame([row], columns=["shard", "block", "first", "bits", "n_ids", "doc_ids", "offsets", "payload"])

        for frame in frames:
            for name, text in zip(frame["id"].astype(object).where(frame["id"].notna(), None), frame["text"]):
                names.append(name if name is None or isinstance(name, str) else int(name))
                parts.append(encode(text) + end)
                held += len(parts[-1]) // 4
                if held >= BLOCK_IDS:
                    yield close()
        if names:
            yield close()

    source = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    shards = parts_for(docs.count(), SHARD_DOCUMENTS, docs.sparkSession)
    ordered = source.repartitionByRange(shards, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    ordered.mapInPandas(run, schema).write.option("compression", "none").parquet(folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a folder with ``start``: the ids of all documents before the block. Sums over one row per shard."""
    table = spark.read.parquet(folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return table.join(F.broadcast(starts), "shard").withColumn("start", F.col("base") + F.col("first")).drop("base")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a folder and, on demand, its ``ids``."""
    table = blocks(spark, folder)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names, offsets, start, bits, payload in zip(frame["doc_ids"], frame["offsets"], frame["start"], frame["bits"], frame["payload"]):
                cut = np.asarray(offsets)
                ids = unpack(payload, int(bits), 0, int(cut[-1]))
                each = [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
                out = pd.DataFrame({"doc_id": list(names), "start": start + cut[:-1].astype("int64"), "n_tokens": np.diff(cut).astype("int64")}, dtype=object)
                out["ids_crc32"] = [zlib.crc32(x.tobytes()) for x in each]
                if with_ids:
                    out["ids"] = [x.astype("int64") for x in each]
                yield out

    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return table.select("doc_ids", "offsets", "start", "bits", "payload").mapInPandas(run, schema)


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole sequence: only the blocks that hold some of them are read."""
    rows = blocks(spark, folder).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).select("start", "n_ids", "bits", "payload")
    cut = [
        unpack(r["payload"], r["bits"], max(0, start - r["start"]), min(r["n_ids"], stop - r["start"])) for r in rows.orderBy("start").toLocalIterator()
    ]
    return np.concatenate(cut) if cut else np.zeros(0, "<u4")


def op8_token_binary(spark, sf_dir: str) -> DataFrame:
    """Every document's place and ids' checksum, read back from the files that ``write_ids`` made."""
    docs = documents(spark, sf_dir)
    folder = fresh_path(spark, "token-ids")
    write_ids(docs, folder, default_tokenizer())
    return read_documents(spark, folder)
