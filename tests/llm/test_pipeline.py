"""The stages against brute-force versions, each on its own input."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_operators import RANKS, brute_cleaned, brute_components, brute_removed
from tideframe.llm import bpe_prefix, mixing, queries, suffix_dedup

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{D}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(str(tmp_path / str(i)))
        kept[name], columns, docs = (docs, spark.read.parquet(str(tmp_path / str(i)))), docs.columns, spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == columns
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = {r[0] for r in duck.execute(f"select doc_id from ({queries.oracle_sql()['op1_quality_rules']}) where kept").fetchall()}
    assert {r.doc_id for r in kept["quality rules"][1].collect()} == want
    before, after = (x.collect() for x in kept["n-gram Jaccard join"])
    assert {r.doc_id for r in after} == {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80) if i == c}
    before, after = (x.collect() for x in kept["suffix-array dedup"])
    assert {r.doc_id: r.text.encode() for r in after} == {r.doc_id: t for r, t in zip(before, brute_cleaned([r.text for r in before], suffix_dedup.LENGTH, 51), strict=True)}
    before, after = kept["mixing sources to target weights"]
    copies = {r.doc_id: len(r.shards) for r in mixing.mixed(before).collect()}
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in copies.items() if n})
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_prefix.encoder(**RANKS).vocabulary.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_and_queries(spark):
    assert corpus_pipeline.run(spark, D).count() > 100
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{i}" for i in range(1, 11)}


def test_passages_of_over_50_words_are_cut(spark):
    letters, word = "abcdefghijklmnopqrstuvwxyz", lambda k, i: f"{k}{i:03d}"
    short = " ".join(letters[i * i % 26] for i in range(51))  # 101 bytes
    long = " ".join(word("p", i) for i in range(51))  # 254 bytes
    fifty = " ".join(word("q", i) for i in range(50))
    own = lambda k: " ".join(word(k, i) for i in range(30))
    texts = [f"{own(f'{k}a')} {p} {own(f'{k}b')}" for k, p in enumerate([short, short, long, long, fifty, fifty])]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, docs, D).collect()}
    assert got == {i: t if i > 3 else t.replace(short, "").replace(long, "") for i, t in enumerate(texts)}


def test_repeats_against_brute_force(spark):
    docs = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{D}/documents.parquet"), D).select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: len(r.text.encode()) for r in corpus_pipeline.repeated_strings(spark, spark.createDataFrame(rows, docs.schema), D).collect()}
    want = {r.doc_id: len(b) for r, b in zip(rows, brute_cleaned([r.text for r in rows], 400, 51), strict=True)}
    assert got == want and sum(want.values()) < sum(len(r.text.encode()) for r in rows)


def test_mixture_is_shuffled(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    mix = mixing.mixed(docs)
    placed = {}
    for r in mixing.shard_rows(mix).collect():
        placed.setdefault(r["shard"], []).append((r["at"], r.doc_id))
    want = Counter(tuple(i for _, i in sorted(x)) for x in placed.values())
    parts = corpus_pipeline.mixture(spark, docs, D).select("doc_id").rdd.map(lambda r: r.doc_id).glom().collect()
    left = Counter()
    for part in parts:  # whole shards, one after the other
        while part:
            shard = next(x for x in want if tuple(part[: len(x)]) == x)
            left[shard] += 1
            part = part[len(shard) :]
    assert left == want


def test_stage_edges(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, and no rows at all."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(1, good, "en", "a", 5, 7), (1, good, "en", "a", 5, 7), (2, good + " end", None, None, None, None), (None, good, "en", "a", 5, 7), (None, None, None, None, None, None), (3, "", "en", "b", 0, 1), (4, " \n", "en", "b", 2, 1), (5, "x" * 300_000, "en", "b", 9, 9), (6, "many " * 50_000, "de", "b", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")
    got = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for some, held in (("rows", docs), ("none", docs.limit(0))):
            stage(spark, held, D).write.parquet(str(tmp_path / f"{some}{i}"))
            got[name, some] = spark.read.parquet(str(tmp_path / f"{some}{i}"))
            assert i == 4 or got[name, some].columns == docs.columns
        assert got[name, "none"].count() == 0
    kept = [r.doc_id for r in got["quality rules", "rows"].collect()]
    assert set(kept) <= {1, 2, None} and len(kept) <= 4, "texts of few words or of one word over and over go"
    near = got["n-gram Jaccard join", "rows"].collect()
    assert sorted(str(r.doc_id) for r in near) == ["1", "3", "4", "5", "6", "None"]
    assert [r.text for r in near if r.doc_id is None] == [None]
    cleaned = got["suffix-array dedup", "rows"].collect()
    assert len(cleaned) == len(rows) and {r.text for r in cleaned if r.doc_id in (5, 6)} <= {"", " "} and sum(r.text is None for r in cleaned) == 1
    assert {r.text.strip() for r in cleaned if r.doc_id in (1, 2)} == {"", "end"}
    ids = {(r.doc_id, r.n_tokens) for r in got["byte-level BPE encoding and decoding", "rows"].collect()}
    assert (None, 0) in ids and (3, 0) in ids
