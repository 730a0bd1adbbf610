"""Stages of corpus_pipeline."""

import corpus_pipeline
from quantloom.llm import neardup


def test_near_duplicates_from_80_percent(spark):
    shared = [f"w{i}" for i in range(100)]

    def tail(k, mark):
        return " ".join(shared[: 100 - k] + [f"{mark}{i}" for i in range(k)])

    # 96 shingles each: 87 of 105 are shared (0.829), then 85 of 107 (0.794)
    rows = [(1, " ".join(shared)), (2, tail(9, "a")), (3, "other words of another text"), (4, tail(11, "b"))]
    near = spark.createDataFrame([r for r in rows if r[0] in (1, 2, 3)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, near, "").collect()) == [1, 3]
    far = spark.createDataFrame([r for r in rows if r[0] in (1, 3, 4)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicated(spark, far, "").collect()) == [1, 3, 4]


def test_rows_without_id(spark):
    def words(mark, n=60):
        return [f"{mark}{i}" for i in range(n)]

    def near(mark):
        return " ".join([*words(mark)[:-1], "changed"])

    a, b, c, d = (" ".join(words(m)) for m in "abcd")
    # without an id: a twice and a near copy, b once, a near copy of c which has an id, two blank texts; d and e share an id
    rows = [(None, a), (None, a), (None, near("a")), (None, b), (3, c), (None, near("c")), (None, " "), (None, None), (7, d), (7, " ".join(words("e"))), (9, " ".join(words("e")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.component_id or 0, r.n_class) for r in got if r.doc_id is None and r.n_shingles) == [(0, 1), (0, 1), (0, 2), (0, 2), (3, 1)]
    assert sum(r.kept for r in got if r.doc_id is None and r.n_shingles) == 2
    assert {r.component_id for r in got if r.doc_id in (7, 9)} == {7}
    kept = [tuple(r) for r in neardup.deduplicated(docs).collect()]
    assert sum(r in ((None, a), (None, near("a"))) for r in kept) == 1
    assert kept.count((None, b)) == 1 and kept.count((3, c)) == 1 and (None, near("c")) not in kept
    assert kept.count((None, " ")) == 1 and kept.count((None, None)) == 1
    assert [i for i, _ in kept if i in (7, 9)] == [7] and len(kept) == 6


def test_stages_and_run(spark, tmp_path):
    """The stages one by one and run() against plain Python on a small table with an extra column."""
    import hashlib
    import random
    from collections import Counter

    import public_tokenizers

    from quantloom.llm import bpe, mixing
    from quantloom.llm.registry import vocabulary

    r = random.Random(3)
    english, german = ["the", "house", "and", "garden", "with", "water", "under", "green"], ["das", "haus", "und", "garten", "mit", "wasser", "unter", "grün"]
    rows = [(k, " ".join(r.choice(english if k % 2 else german) + (f" {k}x{j}" if j % 5 == 0 else "") for j in range(60)), "en" if k % 2 else "de", f"s{k % 3}" if k % 7 else None, 1) for k in range(60)]
    rows += [(100, rows[3][1], None, "s1", 1), (101, rows[3][1] + " more", "en", "s2", 1), (102, None, "en", "s0", 0), (103, "12 34 !", "de", "s0", 0), (104, "", None, None, 0), (None, rows[4][1] + " unter wasser", None, "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'clash' as row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    known = corpus_pipeline.identified(spark, docs, "")
    assert known.columns == docs.columns
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in known.collect()) == sorted([*range(60), 100, 101, -1])
    single = corpus_pipeline.deduplicated(spark, known, "")
    kept = {x.doc_id: x for x in single.collect()}
    assert single.columns == docs.columns and sorted(kept) == list(range(60))
    mixed = corpus_pipeline.mixed(spark, single, "")
    times = Counter(x.doc_id for x in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 2
    size = {k: len(x.text.split()) for k, x in kept.items()}
    taken = Counter()
    for x in mixing.mix(single).collect():
        taken[x.source] += x.taken
    for s, n in taken.items():
        assert abs(sum(size[k] * c for k, c in times.items() if kept[k].source == s) - n) <= max(size[k] for k in kept if kept[k].source == s)
    enc = bpe.encoding(vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in got) == times
    for x in got:
        ids = enc.encode_ordinary(kept[x.doc_id].text)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[x.doc_id].text.encode()).hexdigest())
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language id", "near-duplicates", "mixing", "byte-level BPE"]
