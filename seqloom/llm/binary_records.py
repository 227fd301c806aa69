"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A shard ``*.rec`` is a row of frames. A frame is: payload length (8 bytes, little-endian), masked
CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload (4). The first frame's payload is
JSON about the shard (id type, end id). Every other payload is one document: a byte that is 1 if the
doc_id is known, the doc_id (8 bytes), then the ids in the type named. ``*.idx`` has 24 bytes for
each document: doc_id, offset of its frame, number of ids; reads in a shuffled order seek by it.

Shards cover rising ranges of doc_id (nulls first). A task writes under a name of its own attempt and
reports it; only reported shards count, so that lost or doubled attempts leave the set unharmed.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, bound_batches, partitions, qualified, tidied
from .tokens import default_path, encoder

TOKENIZER = "byte_bpe_50k.json"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    """CRC-32, rotated right by 15 bits plus a constant, so that checksums of checksums stay apart."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def read_frame(f) -> bytes | None:
    """The next payload, None at the end; a ValueError if lengths or checksums don't fit."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:n]


def _open_fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_records(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes shards in ascending doc_id order and returns their list: name, docs, ids, first id's place.

    A null text counts as empty; null doc_ids come first; rows with one doc_id stand together in any
    order, repeated ones too. A text of any length is one record. Other columns have no effect. An
    empty table gives an empty list. The shard list is as long as there are partitions.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    from tokenizers import Tokenizer

    ids_type = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else "<u4"
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    meta = json.dumps({"version": 1, "ids": ids_type, "end_id": end_id}).encode()
    fs, _ = _open_fs(folder)
    fs.create_dir(_open_fs(folder)[1], recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (fs, root) = encoder(path), _open_fs(folder)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        docs_n = ids_n = at = 0
        with fs.open_output_stream(f"{root}/{name}.rec") as rec, fs.open_output_stream(f"{root}/{name}.idx") as idx:
            at += rec.write(first := frame(meta)) or len(first)
            for b in (batch.slice(lo, 250) for batch in batches for lo in range(0, batch.num_rows, 250)):
                keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                index = np.zeros(len(keys), INDEX)
                for k, raw in enumerate(coder.encode([t or "" for t in texts])):
                    ids = np.frombuffer(raw + tail, "<u4").astype(ids_type)
                    out = frame(struct.pack("<Bq", keys[k] is not None, keys[k] or 0) + ids.tobytes())
                    rec.write(out)
                    index[k] = keys[k] or 0, at, len(ids)
                    at += len(out)
                    ids_n += len(ids)
                docs_n += len(keys)
                idx.write(index.tobytes())
        if docs_n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "docs": pa.array([docs_n], pa.int64()), "ids": pa.array([ids_n], pa.int64())})

    # Rows of one doc_id, or none, are told apart by a number, so that ranges can split them
    keys = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(partitions(spark, docs), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards, start = [], 0
    for r in sorted(rows.mapInArrow(tidied(write), "part int, name string, docs long, ids long").collect(), key=lambda r: r.part):  # a row for each partition
        shards.append({"name": r.name, "docs": r.docs, "ids": r.ids, "start": start})
        start += r.ids
    where = _open_fs(folder)[1]
    kept = {f"{s['name']}.{x}" for s in shards for x in ("rec", "idx")}
    from pyarrow.fs import FileSelector

    for info in fs.get_file_info(FileSelector(where)):
        if info.base_name.startswith("shard-") and info.base_name not in kept:
            fs.delete_file(info.path)
    with fs.open_output_stream(f"{where}/shards.json") as f:
        f.write(json.dumps(shards).encode())
    return shards


def read_documents(fs, root: str, name: str, order: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of one shard: all in file order, or those of the index rows named, in that order."""
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        meta = json.loads(read_frame(f))
        if order is None:
            bodies: Iterator[bytes] = iter(lambda: read_frame(f), None)  # type: ignore[arg-type]
        else:
            with fs.open_input_stream(f"{root}/{name}.idx") as g:
                index = np.frombuffer(g.read(), INDEX)

            def seek() -> Iterator[bytes]:
                for k in order:
                    f.seek(int(index["offset"][k]))
                    yield read_frame(f)

            bodies = seek()
        for body in bodies:
            known, doc = struct.unpack_from("<Bq", body)
            yield (doc if known else None), np.frombuffer(body, meta["ids"], offset=9)


def digest_records(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; each frame and the index are verified."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}.idx") as g:
                    index = np.frombuffer(g.read(), INDEX)
                rows: tuple[list, ...] = ([], [], [], [])
                seen = 0
                for doc, ids in read_documents(fs, root, name):
                    if index["n"][seen] != len(ids) or index["doc_id"][seen] != (doc or 0):
                        raise ValueError(f"the index of {name} doesn't fit its records")
                    seen += 1
                    for column, x in zip(rows, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        column.append(x)
                    start += len(ids)
                    if len(rows[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = ([], [], [], [])
                if seen != len(index):
                    raise ValueError(f"{name} lacks records")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long")
    return files.repartition(max(1, len(shards))).mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_records(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = qualified(spark, Workspace(spark, "records").root)
    return digest_records(spark, folder, write_records(docs, folder, default_path(TOKENIZER)))
