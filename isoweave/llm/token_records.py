"""Token ids of documents in length-delimited binary record files, with offset indexes.

A shard is two files.  ``*.rec`` holds records one after the other, each
    length   8 bytes, little-endian
    check    4 bytes, masked CRC-32 of the 8 length bytes
    payload  ``length`` bytes
    check    4 bytes, masked CRC-32 of the payload
and a payload is the document's id (8 bytes, or the null mark), the width of an
id (1 byte: 2 or 4) and the ids themselves, little-endian, at that width.
``*.idx`` holds one row of four 8-byte integers per record: document id, place
of the record, its whole size, number of ids.  With it records can be read in
any order.  The mask (a rotation and an offset) keeps a check over data that
holds checks from being degenerate; the check is zlib's CRC-32.

Documents are dealt by id range, sorted within a range, and each range writes
one shard into the shared folder under a name of its own attempt, so a task
that runs twice leaves a file that no manifest names.  The manifest (one row a
shard) has each shard's count of ids, from which global places follow.

Defined cases: null text is empty, and an empty text is the end id alone; a
null id sorts first; rows with the same id are ordered by a hash of the text;
extra columns are ignored; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm.common import Workspace, need
from isoweave.llm.encode import encoder, word_bpe

NULL_ID = -(2**63)
MANIFEST = "shard int, path string, n_records long, n_tokens long, n_bytes long"
#: Bytes of records that a reader takes at once.
READ_BYTES = 8 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at``, and where the next one begins."""
    head = bytes(data[at : at + 8])
    (length,) = struct.unpack("<Q", head)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked_crc(head):
        raise ValueError(f"bad length check at {at}")
    payload = bytes(data[at + 12 : at + 12 + length])
    if len(payload) != length or struct.unpack("<I", data[at + 12 + length : at + 16 + length])[0] != masked_crc(payload):
        raise ValueError(f"bad payload check at {at}")
    return payload, at + 16 + length


def pack_ids(doc_id: int | None, ids: bytes) -> bytes:
    """``ids`` are little-endian 32-bit; kept at 16 bits where they all fit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not len(wide) or int(wide.max()) < 1 << 16
    body = wide.astype("<u2").tobytes() if narrow else ids
    return struct.pack("<qB", NULL_ID if doc_id is None else doc_id, 2 if narrow else 4) + body


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    doc_id, width = struct.unpack("<qB", payload[:9])
    ids = payload[9:] if width == 4 else np.frombuffer(payload, "<u2", offset=9).astype("<u4").tobytes()
    return None if doc_id == NULL_ID else doc_id, ids


def _open(uri: str):
    """(file system, path) of a URI; the shared folder may be any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_token_records(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """Write the shards; return the manifest: MANIFEST and ``first``, the ids before the shard."""
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    work = work or Workspace(spark, "token_records")
    folder, path, end = work.path("shards"), tokenizer or word_bpe(), np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = _open(folder)
        store.create_dir(where, recursive=True)
        shard, rec, index, at, total, n = TaskContext.get().partitionId(), None, [], 0, 0, 0
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        enc = encoder(path)
        for batch in batches:
            if rec is None and batch.num_rows:
                rec = store.open_output_stream(f"{where}/{name}.rec")
            for i, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                record = frame(pack_ids(i, ids + end))
                rec.write(record)
                index.append((NULL_ID if i is None else i, at, len(record), len(ids) // 4 + 1))
                at, total, n = at + len(record), total + len(ids) // 4 + 1, n + 1
        if rec is not None:
            rec.close()
            with store.open_output_stream(f"{where}/{name}.idx") as out:
                out.write(np.array(index, "<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_records": [n], "n_tokens": [total], "n_bytes": [at]})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = src.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    shards = work.save(dealt.mapInArrow(write, MANIFEST), "manifest").collect()  # one row a file
    rows, first = [], 0
    for r in sorted(shards, key=lambda r: r.shard):
        rows.append((*r, first))
        first += r.n_tokens
    return spark.createDataFrame(rows, MANIFEST + ", first long")


def read_token_records(manifest: DataFrame, *, seed: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian 32-bit).

    Every check is verified.  With a ``seed`` the shards come in a shuffled
    order and each shard's records too, by way of its index.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, where = _open(row["path"])
                with store.open_input_file(f"{where}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
                starts = row["first"] + np.cumsum(index[:, 3]) - index[:, 3]
                with store.open_input_file(f"{where}.rec") as f:
                    yield from _records(f, index, starts, seed, row["shard"])

    shards = max(1, manifest.count())
    if seed is None:
        dealt = manifest.repartition(shards)
    else:
        dealt = manifest.repartitionByRange(shards, F.xxhash64(F.lit(seed), "shard"))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _records(f, index: np.ndarray, starts: np.ndarray, seed: int | None, shard: int) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "n_tokens": pa.array([r[2] for r in rows], pa.int64()), "ids": pa.array([r[3] for r in rows], pa.binary())})

    def record(data, at: int, k: int) -> tuple:
        payload, _ = unframe(data, at)
        doc_id, ids = unpack_ids(payload)
        if len(ids) != 4 * index[k, 3] or (NULL_ID if doc_id is None else doc_id) != index[k, 0]:
            raise ValueError("record and index differ")
        return doc_id, int(starts[k]), len(ids) // 4, ids

    if seed is None:
        k = 0
        while k < len(index):
            last = max(k + 1, int(np.searchsorted(index[:, 1], index[k, 1] + READ_BYTES)))
            base, size = int(index[k, 1]), int(index[last - 1, 1] + index[last - 1, 2] - index[k, 1])
            f.seek(base)
            data = memoryview(f.read(size))
            yield out([record(data, int(index[i, 1]) - base, i) for i in range(k, last)])
            k = last
        return
    todo = np.random.default_rng([seed, shard]).permutation(len(index))
    for part in np.array_split(todo, max(1, int(index[:, 2].sum()) // READ_BYTES)):
        rows = []
        for k in part.tolist():
            f.seek(int(index[k, 1]))
            rows.append(record(memoryview(f.read(int(index[k, 2]))), 0, k))
        yield out(rows)


def token_records(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the files, then read them back."""
    return read_token_records(write_token_records(docs, **options))
