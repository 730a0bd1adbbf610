"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts longer than this many characters are encoded in parts, cut where no match can cross.
PART = 1 << 16
#: Runs of white space at least this long are matched here; the library's regex engine may overflow on them.
RUN = 4096
_SPACE = r"\t-\r \x85\xa0  -     　"
_RUNS = regex.compile(f"[{_SPACE}]{{{RUN},}}")
#: A letter, then one blank and a letter: a letter run ends here and the next match starts with the blank.
_SAFE = regex.compile(r"[A-Za-z](?= [A-Za-z])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a rank file, once a Python worker."""
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def parts(text: str, part: int = PART) -> Iterator[str]:
    """The text in pieces of about `part` characters, cut at safe boundaries only (never, if it has none)."""
    at = 0
    while len(text) - at > part:
        m = _SAFE.search(text, at + part - 1)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(text: str, enc) -> list[int]:
    """Token ids of a whole text, equal to encode_ordinary() of the library wherever that can run.

    A long run of white space is one match but for its last character if something follows it, so it
    is handed to the library as a single piece.
    """
    ids: list[int] = []
    at = 0
    if len(text) >= RUN:
        for m in _RUNS.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            for x in parts(text[at : m.start()]):
                ids += enc.encode_ordinary(x)
            ids += enc._core_bpe.encode_single_piece(text[m.start() : end].encode())
            at = end
    for x in parts(text[at:]) if at or len(text) > PART else (text,):
        ids += enc.encode_ordinary(x)
    return ids


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids array<int>, decoded binary (the bytes that the ids stand for).

    Null text counts as empty and gives no ids. Repeated rows give repeated rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                ids = [encode(t or "", enc) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode_bytes(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, but with n_tokens and the two digests in place of ids and bytes.

    doc_id, n_tokens long, ids_sha256 (of the decimal ids joined by a blank), decoded_sha256. The digests
    are made next to the ids, so ids don't travel back to the JVM. Null text: as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        decimal = [str(k) for k in range(enc.max_token_value + 1)].__getitem__
        for batch in batches:
            n, by_ids, by_bytes = [], [], []
            for t in batch.column(1):
                ids = encode(t.as_py() or "", enc)
                n.append(len(ids))
                by_ids.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                by_bytes.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
