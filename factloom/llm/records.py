"""Token-id output as length-delimited binary records with masked checksums and a separate offset index.

A record is: the length of its data (8 bytes, little-endian), the masked CRC-32C of those 8 bytes, the data, the
masked CRC-32C of the data (the TFRecord framing). The data of a document is its token ids, 2 bytes each
(4 where the vocabulary has more than 65,536 ids). Each partition writes one shard file, named for its attempt. The
index, a Parquet table beside the shards, has a row for each record: shard, number, offset, length, document. It is
committed with its task, so it names the file of the attempt that counts; what attempts that were lost or ran twice
have left is deleted once the index stands. A reader shuffles index rows and reads single records by offset.

Defined results: null and empty texts give a record of no tokens; a null id stays null in the index; repeated rows
give a record each; an empty table gives an empty index and no shard; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tokens import VOCABULARY, load_vocabulary, pretokens, text_blocks
from factloom.session import fresh_path

CHUNK = 256
FRAME = 16  # bytes that framing adds to a record
INDEX = "shard string, record long, offset long, length long, doc_id long, n_tokens long"


@functools.cache
def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


@functools.cache
def zero_shift() -> np.ndarray:
    """Four tables that advance a CRC state over CHUNK zero bytes (a linear map, taken byte by byte)."""
    table = crc_table()
    state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(CHUNK):
        state = (state >> np.uint32(8)) ^ table[state & 255]
    return state.reshape(4, 256)


def crc32c(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each row's bytes. Chunks of CHUNK bytes are read in lockstep and then joined."""
    table, shift = crc_table(), zero_shift()
    size = np.diff(offsets)
    rows = len(size)
    head = size % CHUNK  # a row's first chunk is the short one
    state = np.full(rows, 0xFFFFFFFF, np.uint32)
    order = np.argsort(-head, kind="stable")
    live = np.searchsorted(-head[order], -np.arange(CHUNK), "left")
    s = state[order]
    at = offsets[:-1][order]
    for k in range(int(head.max(initial=0))):
        m = live[k]
        s[:m] = (s[:m] >> np.uint32(8)) ^ table[(s[:m] ^ raw[at[:m] + k]) & 255]
    state[order] = s
    whole = size // CHUNK
    if whole.any():
        firsts = np.concatenate([[0], np.cumsum(whole)])
        owner = np.repeat(np.arange(rows), whole)
        start = offsets[:-1][owner] + head[owner] + (np.arange(firsts[-1]) - firsts[owner]) * CHUNK
        part = np.zeros(len(start), np.uint32)
        for s in range(0, len(start), 1 << 15):
            grid = np.ascontiguousarray(raw[start[s : s + (1 << 15), None] + np.arange(CHUNK)].T)
            p = np.zeros(grid.shape[1], np.uint32)
            for k in range(CHUNK):
                p = (p >> np.uint32(8)) ^ table[(p ^ grid[k]) & 255]
            part[s : s + (1 << 15)] = p
        order = np.argsort(-whole, kind="stable")
        s = state[order]
        most = whole[order]
        for k in range(int(most[0])):
            m = int(np.searchsorted(-most, -k, "left"))
            x = s[:m]
            s[:m] = shift[0][x & 255] ^ shift[1][x >> 8 & 255] ^ shift[2][x >> 16 & 255] ^ shift[3][x >> 24] ^ part[firsts[order[:m]] + k]
        state[order] = s
    return ~state


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated and shifted, so that checksums of data that holds checksums stay sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frame(data: list[bytes]) -> list[bytes]:
    """Each byte string as a whole record."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64)
    body = masked(crc32c(np.frombuffer(b"".join(data), np.uint8), offsets))
    sizes = np.diff(offsets).astype("<u8")
    head = masked(crc32c(np.frombuffer(sizes.tobytes(), np.uint8), np.arange(len(data) + 1) * 8))
    return [struct.pack("<QI", n, h) + x + struct.pack("<I", b) for n, h, x, b in zip(sizes.tolist(), head.tolist(), data, body.tolist())]


class WordIds(dict):
    """Pre-token to the bytes of its token ids; bounded."""

    def __init__(self, path: str) -> None:
        import tiktoken

        ranks = load_vocabulary(path)
        self.kind = "<u2" if max(ranks.values()) < 1 << 16 else "<u4"
        self.encode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        found = np.array(self.encode(word), self.kind).tobytes()
        if len(word) < 64:
            self[word] = found
        return found


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_records(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write ``docs`` as record shards and index under ``path``; returns the index as read from its table."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        width = int(ids.kind[-1])
        shard = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.rec"
        fs, base = open_fs(path)
        own = f"{base}/{shard}"
        out, offset, number = None, 0, 0
        try:
            for batch in batches:
                for a, b, texts in text_blocks(batch, 1):
                    data = [b"".join(map(ids.__getitem__, words)) for _, words in pretokens(texts)]
                    records = frame(data)
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(own)
                    out.write(b"".join(records))
                    sizes = np.fromiter(map(len, records), np.int64, len(records))
                    ends = offset + np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard] * len(data)),
                            pa.array(np.arange(number, number + len(data))),
                            pa.array(ends - sizes),
                            pa.array(sizes),
                            batch.column(0).slice(a, b - a),
                            pa.array((sizes - FRAME) // width),
                        ],
                        ["shard", "record", "offset", "length", "doc_id", "n_tokens"],
                    )
                    offset, number = int(ends[-1]), number + len(data)
        finally:
            if out is not None:
                out.close()

    index = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, INDEX)
    index.write.mode("overwrite").parquet(f"{path}/index")
    stored = spark.read.schema(index.schema).parquet(f"{path}/index")
    fs, base = open_fs(path)
    known = {r[0] for r in stored.select("shard").distinct().collect()}  # one name a partition
    for found in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if found.base_name.endswith(".rec") and found.base_name not in known:
            fs.delete_file(found.path)
    return stored


def read_shuffled(index: DataFrame, path: str, seed: int, width: int = 2) -> DataFrame:
    """``doc_id, tokens`` of all records in an order that the seed makes: each partition of the shuffled index reads
    its records by offset."""
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for batch in batches:
            rows = batch.to_pylist()
            tokens: list = [None] * len(rows)
            # a batch's records are read in the order of the disk, each shard opened once
            for shard, own in itertools.groupby(sorted(range(len(rows)), key=lambda k: (rows[k]["shard"], rows[k]["offset"])), key=lambda k: rows[k]["shard"]):
                with fs.open_input_file(f"{base}/{shard}") as f:
                    for k in own:
                        tokens[k] = parsed(f.read_at(rows[k]["length"], rows[k]["offset"]), rows[k]["length"], width).astype(kind).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    order = F.xxhash64(F.lit(seed), "shard", "record")
    return index.repartition(order).sortWithinPartitions(order).mapInArrow(run, "doc_id long, tokens array<int>")


def read_record(path: str, shard: str, offset: int, length: int, width: int = 2) -> np.ndarray:
    """The token ids of one record, both checksums verified."""
    fs, base = open_fs(path)
    with fs.open_input_file(f"{base}/{shard}") as f:
        return parsed(f.read_at(length, offset), length, width)


def parsed(raw: bytes, length: int, width: int) -> np.ndarray:
    """The token ids of a framed record; ValueError where it is damaged."""
    if len(raw) != length or length < FRAME:
        raise ValueError("truncated record")
    size, head = struct.unpack("<QI", raw[:12])
    body = np.frombuffer(raw, np.uint8)[12 : length - 4]
    want = masked(crc32c(np.frombuffer(raw, np.uint8)[:8], np.array([0, 8])))[0]
    if size != length - FRAME or head != want:
        raise ValueError("bad record length")
    if struct.unpack("<I", raw[-4:])[0] != masked(crc32c(body, np.array([0, len(body)])))[0]:
        raise ValueError("bad record checksum")
    return np.frombuffer(body.tobytes(), f"<u{width}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_records(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fresh_path(spark, "records"))
