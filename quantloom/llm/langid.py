"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: n-grams of 1 to this many characters; a code point takes 21 bits of an n-gram's 64-bit code.
ORDERS = 3
#: Length of a profile: a language's and a document's most frequent n-grams.
PROFILE = 400
#: First step of the top of a language: by (language, slice of n-grams), so that no language sits in one task.
SLICES = 64
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: lower case, every run of anything but letters is one blank (code 1)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = letters()[points]
    if not kept.any():
        return np.empty(0, np.int64)
    c = np.where(kept, points, 1).astype(np.int64)
    c = np.concatenate(([1], c, [1]))
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    grams, code = [c[c != 1]], c
    for n in range(2, ORDERS + 1):
        code = code[:-1] << 21 | c[n - 1 :]
        grams.append(code)
    return np.concatenate(grams)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order and their counts."""
    grams = np.sort(grams)
    at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
    return grams[at], np.diff(np.append(at, len(grams)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        kept = counts >= least
        codes, counts = codes[kept], counts[kept]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def train(labelled: DataFrame, profile: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's n-grams by rank, from all the rows given.

    Counts are summed per batch in the tasks and by Spark across them; the driver gets at most
    `profile` numbers a language. Null texts or labels, and texts without letters, add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            held: dict[str, int] = {}
            out: list[tuple[str, np.ndarray, np.ndarray]] = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_lang.setdefault(lang, []).append(g := ngrams(text.as_py()))
                held[lang] = held.get(lang, 0) + len(g)
                if held[lang] > 4_000_000:
                    out.append((lang, *counted(np.concatenate(by_lang.pop(lang)))))
                    held[lang] = 0
            out += [(lang, *counted(np.concatenate(x))) for lang, x in by_lang.items()]
            for lang, codes, counts in out:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang", "slice").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("slice", F.pmod(F.xxhash64("gram"), F.lit(SLICES))).withColumn("r", F.row_number().over(first)).where(F.col("r") <= profile)
    # at most SLICES * profile entries a language meet in one group
    best = top.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, profile).alias("best"))
    return {r.lang: [x.gram for x in r.best] for r in best.collect()}


def out_of_place(text: str | None, langs: list[str], codes: np.ndarray, ranks: np.ndarray, profile: int = PROFILE) -> tuple[str, float]:
    """The nearest language and 1 - distance / greatest possible distance.

    codes: all profiles' codes in ascending order; ranks: for each code a row of every language's
    rank, `profile` for a code that the language lacks. Ties go to the first language in order.
    """
    if not text or not langs:
        return UNKNOWN, 0.0
    own = ngrams(text)
    if not len(own):
        return UNKNOWN, 0.0
    own = ranked(*counted(own), profile)
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    found = codes[at] == own
    place = ranks[at]
    gap = np.where((found[:, None]) & (place < profile), np.abs(place - np.arange(len(own))[:, None]), profile)
    total = gap.sum(axis=0)
    k = int(total.argmin())
    return langs[k], 1.0 - float(total[k]) / (profile * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string and score double, from the text alone.

    `und` and score 0.0 where text is null, empty or without letters, or no language was learned.
    Rows, their order and all other columns stay; columns of these two names are replaced.
    """
    langs = sorted(x for x in profiles if profiles[x])
    codes = np.unique(np.array([c for x in langs for c in profiles[x]], np.int64))
    ranks = np.full((len(codes), len(langs)), profile, np.int64)
    for k, x in enumerate(langs):
        ranks[np.searchsorted(codes, np.array(profiles[x], np.int64)), k] = np.arange(len(profiles[x]))

    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [out_of_place(t.as_py(), langs, codes, ranks, profile) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the fold that nothing is learned from: crc32 of the id's text mod folds is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the labelled rows outside the held-out fold.

    Only text (and, of those rows, lang) is used. Repeated rows count as often as they stand there.
    """
    fold = held_out()
    profiles = train(docs.where(~fold & F.col("doc_id").isNotNull()), profile)
    return predict(docs.select("doc_id", fold.alias("held_out"), "text"), profiles, profile).drop("text")
