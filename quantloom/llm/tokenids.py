"""Token ids on disk: documents in ascending order, ids range-coded in segments, read back to documents.

A file is a table of segments. A segment holds the ids of consecutive documents as rangecoder.pack() makes
them (independent blocks with checksums), and the documents' ids and sizes. A document may go on in the
next segments. Segments are ranges of doc_id, so the position of a document's first id among all ids
follows from the segments' sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import rangecoder, wordids
from quantloom.llm.common import TIES, order_buckets, running_totals, shared_path

#: A segment has at most this many ids; a longer document goes on in the next one.
SEGMENT = 1 << 22
#: Documents a bucket, that is, a sorted run of one task.
ROWS = 2000
_CHECK = 0xEDB88320


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2) -> None:
    """Writes the segments of all documents: ids of the whole text, then end_id, in ascending doc_id order (null first).

    Null text has the end id only. Repeated ids stay documents of their own, by their texts' hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashed = F.xxhash64("text")
    dealt = rows.withColumn("bucket", order_buckets(rows, "doc_id", hashed, ROWS)).repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), hashed)
    schema = pa.schema([("bucket", pa.int64()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("first", pa.int64()), ("begun", pa.bool_()), ("open", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wordids.word_ids(tokenizer_file)
        room = np.empty(SEGMENT, np.uint32)
        filled, names, sizes = 0, [], []
        bucket, segment, first, begun = None, 0, 0, False

        def closed(open_: bool) -> pa.RecordBatch:
            row = {"bucket": bucket, "segment": segment, "n_ids": filled, "first": first, "begun": begun, "open": open_, "doc_ids": names, "sizes": sizes, "payload": rangecoder.pack(room[:filled])}
            return pa.RecordBatch.from_pylist([row], schema)

        for b, name, ids in _documents(batches, words, end_id):
            if names and b != bucket:
                yield closed(False)
                filled, names, sizes = 0, [], []
            if b != bucket:
                bucket, segment, first, begun = b, 0, 0, False
            if filled == SEGMENT:
                yield closed(False)
                filled, segment, first, begun, names, sizes = 0, segment + 1, first + len(names), False, [], []
            names.append(name)
            sizes.append(0)
            for part in ids:
                while len(part):
                    if filled == SEGMENT:
                        yield closed(True)
                        filled, segment, first, begun, names, sizes = 0, segment + 1, first + len(names) - 1, True, [name], [0]
                    n = min(len(part), SEGMENT - filled)
                    room[filled : filled + n] = part[:n]
                    filled, part = filled + n, part[n:]
                    sizes[-1] += n
        if names:
            yield closed(False)

    dealt.select("doc_id", "text", "bucket").mapInArrow(run, "bucket long, segment int, n_ids long, first long, begun boolean, open boolean, doc_ids array<long>, sizes array<long>, payload binary").write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch], words: wordids.WordIds, end_id: int) -> Iterator[tuple[int, int | None, Iterator[np.ndarray]]]:
    """bucket, doc_id and the ids, in parts, of each row."""
    end = np.array([end_id], np.int64)

    def long(text: str) -> Iterator[np.ndarray]:
        for part in wordids.parts(text):
            yield words.encode(pa.array([part], pa.large_string()))[0]
        yield end

    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            names, buckets = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            text = batch.column(1)
            if text.nbytes > 4 * wordids.PART:
                for name, b, t in zip(names, buckets, text, strict=True):
                    yield b, name, long(t.as_py())
                continue
            ids, n = words.encode(text)
            at = np.cumsum(n)
            ids = np.insert(ids, at, end_id)
            stop = at + np.arange(1, len(n) + 1)
            for name, b, u, v in zip(names, buckets, (stop - n - 1).tolist(), stop.tolist(), strict=True):
                yield b, name, iter((ids[u:v],))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document in the files; for pipelines that need the ids themselves.

    A document that goes over several segments has a row for each, by ascending start.
    """
    return _placed(spark, path, True).select("doc_id", "start", "ids")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files.

    The checksums of a document's parts are combined, so no row or task needs a long document whole.
    """
    out = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = _placed(spark, path, False).where("not part").select(out)
    # segments that hold a part of a document, as a rule few or none
    placed = _placed(spark, path, False, "begun or open")
    pieces = F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32")))
    parts = placed.where("part").groupBy("bucket", "number").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), pieces.alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for row in batch.column(3).to_pylist():
                at = 0
                for piece in row:
                    at = joined_crc(at, piece["ids_crc32"], 4 * piece["n_tokens"])
                sums.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], out)

    return whole.unionByName(parts.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements modulo the checksum's; the highest bit is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_CHECK if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, n: int) -> int:
    """The crc32 of two runs of bytes end to end, from theirs and the second's length: first * x**(8 n) + second."""
    power, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, first) ^ second


def _placed(spark: SparkSession, path: str, with_ids: bool, some: str = "true") -> DataFrame:
    """bucket, number (of the document in it), part (whether it is one of several of a document), doc_id, start, n_tokens, ids_crc32 or ids."""
    out = [("bucket", pa.int64()), ("segment", pa.int32()), ("number", pa.int64()), ("part", pa.bool_()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64())]
    schema = pa.schema([*out, ("ids", pa.list_(pa.int64())) if with_ids else ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, segment, first, begun, open_, names, sizes, payload = (batch.column(k)[row].as_py() for k in range(8))
                ids = rangecoder.unpack(payload)
                ends = np.cumsum(sizes)
                part = np.zeros(len(names), bool)
                part[0], part[-1] = begun or (open_ and len(names) == 1), open_ or (begun and len(names) == 1)
                columns = [np.full(len(names), bucket), np.full(len(names), segment, np.int32), first + np.arange(len(names)), part, pa.array(names, pa.int64()), ends - sizes, np.array(sizes)]
                if with_ids:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int64()))
                else:
                    data = memoryview(ids.astype("<u4")).cast("B")
                    last = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], last], schema=schema)

    files = spark.read.parquet(path)
    ddl = "bucket long, segment int, number long, part boolean, doc_id long, before long, n_tokens long, " + ("ids array<long>" if with_ids else "ids_crc32 long")
    documents = files.where(some).select("bucket", "segment", "first", "begun", "open", "doc_ids", "sizes", "payload").mapInArrow(run, ddl)
    coarse = F.shiftright("bucket", TIES)
    placed = running_totals(files.select("bucket", "segment", "n_ids"), "n_ids", "base", [F.col("bucket"), F.col("segment")], [], F.floor(coarse / 1024).cast("long"))
    bases = placed.select(F.col("bucket").alias("_b"), F.col("segment").alias("_s"), "base")
    joined = documents.join(bases, (F.col("bucket") == F.col("_b")) & (F.col("segment") == F.col("_s")))
    return joined.withColumn("start", F.col("base") + F.col("before")).drop("_b", "_s", "base", "before")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 2) -> DataFrame:
    """read_documents() of files that write_ids() puts into the shared folder."""
    path = shared_path(docs.sparkSession, "token_ids")
    write_ids(docs, path, tokenizer_file, end_id)
    return read_documents(docs.sparkSession, path)
