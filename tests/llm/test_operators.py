"""Every operator against a brute-force version, and with nulls, empty and long texts, repeated rows, empty tables and
columns of clashing names."""

import hashlib
import random
import re
import tracemalloc
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideframe.llm import bpe_prefix, common, media_png, mixing, ngram_join, pairwise_quality, quality_rules, queries, suffix_dedup, token_files, toxicity, url_filters

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, label string, n_words int, spans string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def texts():
    rnd = random.Random(4)
    syllables = ["the", "an", "re", "on", "ti", "é", "ñ", "zu", "ing"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    base, passage = say(220), say(90)
    near = base.split()
    near[40] = "changed"
    out = [None, "", " \n\t", "one", "two words", base, base, base.upper(), " ".join(near), passage + say(30), say(40) + " " + passage, say(20) + passage]
    out += ["aaaa" * 300, "ab" * 500 + "x", "line\nline\n\nline\nother", "éé’s 12 don't \x1c　 <|endoftext|>", say(4000), "x" * 30_000]
    return out + [say(rnd.randint(1, 60)) for _ in range(12)]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    sources = ["b", "a", None, "é", "c"]
    out = [(i, x, ["en", None, "de"][i % 3], sources[i % 5], i, 7, -1, "n", 3, "s") for i, x in enumerate(t)]
    return [*out, out[5], (None, "one more text without an id", "en", "a", 1, 7, -1, "n", 3, "s")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared ----------------------------------------------------------------------------------------------------------


def test_working_tables(spark):
    made = common.written(spark.range(10), "trial")
    here = [p for p in common.left(spark) if "/trial-" in p]
    assert made.count() == 10 and len(here) == 1
    common.drop_written(made.select("id"))
    assert not any("/trial-" in p for p in common.left(spark))
    assert spark.conf.get(common.CLEANUP, None) in (None, "false")


def test_a_cluster_needs_a_shared_folder():
    assert all(map(common.is_one_process, ["local", "local[4]", "local[*]"]))
    assert not any(map(common.is_one_process, ["local-cluster[2,1,1024]", "yarn", "spark://h:7077", "k8s://h"]))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_quality_measures(docs, rows):
    got = {(r.doc_id, r.text): r for r in quality_rules.features(docs).collect()}
    for doc_id, text, *_ in rows:
        w, r = words(text), got[doc_id, text]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want


def test_binomial_tail_is_exact(spark):
    from math import comb

    df = spark.createDataFrame([(n, k) for n in (1, 5, 60, 200) for k in range(0, 20) if k <= n], "n long, k long")
    for r in df.withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.1)).collect():
        want = sum(comb(r.n, j) * 0.1**j * 0.9 ** (r.n - j) for j in range(r.k + 1)) if r.k < 0.1 * r.n else 1.0
        assert abs(r.p - want) < 1e-9


def test_cutoffs_need_evidence(spark):
    good, bad = "plain words that stand here for a good text of ten words", " ".join(f"#{c}$" for c in "abcdefghijkl")
    many = [(i, good if i % 2 else bad, "en") for i in range(2000)] + [(5000 + i, good if i % 2 else bad, "rare") for i in range(10)]
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(df, labels).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(2000)), "a certified cutoff drops the bad ones"
    assert all(kept[5000 + i] for i in range(10)), "ten labels certify nothing"


def test_quality_rules_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (0, 1), (5, None), (None, 1), (999, 0)], "doc_id long, quality int")
    assert quality_rules.quality_rules(docs, labels).count() == docs.count()
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.good_documents(docs, labels.limit(0)).columns == docs.columns


# --- 2 ---------------------------------------------------------------------------------------------------------------

URLS = [None, "", "x", "http://", "HTTP://A.Org/x", "https://ORG?x=/es/", "http://a.example.org/es/1#q", "ftp://x.com/fr", "http://b.com/fr/?a", "http://é.example.org/en/1", "://org/", "http://a.org/://com/de/", "http://myorg/", "http://u@h.com/de/x?y#z"]


def split_url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v", "r") for i, u in enumerate(URLS)], "page_id int, url string, host string, verdict string, rule string")
    for r in url_filters.url_filter(pages, queries.URL_RULES).collect():
        host, path = split_url(r.url)
        fits = [n for n, _ in queries.URL_RULES if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith("/" + n.partition("/")[2])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits, key=len, default=None))
        assert r.verdict == dict(queries.URL_RULES).get(r.rule, r.verdict) and r.verdict in ("allow", "block")
    assert url_filters.url_filter(pages.limit(0), queries.URL_RULES).count() == 0


def test_first_split_by_brute_force(spark):
    """The root of the first tree has the best second-order gain of all splits, and its leaves' children the right weights."""
    rnd, k = random.Random(4), len(url_filters.FEATURES)
    rows = []
    for _ in range(400):
        x = [rnd.randint(0, 4) for _ in range(k)]
        rows.append((x, int(x[3] + 0.5 * x[7] + rnd.random() > 3.2), rnd.randint(1, 3)))
    start, trees = url_filters.fit(spark.createDataFrame(rows, "_x array<long>, y int, n long"), trees=1, depth=1)
    p = 1 / (1 + np.exp(-start))
    x, y, n = (np.array([r[i] for r in rows]) for i in range(3))
    g, h = n * (p - y), n * p * (1 - p)
    gain = lambda keep: g[keep].sum() ** 2 / (h[keep].sum() + url_filters.L2)
    splits = {(f, v): gain(x[:, f] <= v) + gain(x[:, f] > v) for f in range(k) for v in range(4) if min(n[x[:, f] <= v].sum(), n[x[:, f] > v].sum()) >= url_filters.LEAST}
    f, v = max(splits, key=splits.get)
    tree = trees[0]
    assert abs(start - np.log((n * y).sum() / (n * (1 - y)).sum())) < 1e-9 and tree[1] == (f, v)
    for node, keep in ((2, x[:, f] <= v), (3, x[:, f] > v)):
        assert abs(tree[node] + url_filters.RATE * g[keep].sum() / (h[keep].sum() + url_filters.L2)) < 1e-4


def test_trees_learn_and_generalise(spark):
    rnd = random.Random(2)
    bad = lambda: f"http://h{rnd.randint(10**8, 10**9)}.net/{rnd.randint(10**6, 10**7)}?a=1&b=2&c=3"
    good = lambda: f"http://{''.join(rnd.choices('aeioulnrst', k=9))}.net/page/about"
    ruled = [("bad/" if i % 2 else "good/", (bad if i % 2 else good)()) for i in range(600)]
    urls = [u.replace(".net/", f".net.{r}", 1) for r, u in ruled]
    held = [(bad if i % 2 else good)() for i in range(100)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + held)], "page_id int, url string")
    got = url_filters.url_filter(pages, [("good/", "allow"), ("bad/", "block")]).collect()
    right = [r.verdict == ("block" if r.page_id % 2 else "allow") for r in got if r.page_id >= 600]
    assert len(right) == 100 and sum(right) >= 90


# --- 3 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    for n in (0, 1, 575, 576, 577, 20_000):
        data = media_png.padded(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert media_png.decode(media_png.encode(data, kinds=(kind,))).tobytes() == data
    rgb = rng.integers(0, 256, (5, 9), dtype=np.uint8)
    assert (media_png.unfiltered(np.full(5, kind, np.uint8), media_png.filtered(rgb, 3, kind), 3) == rgb).all()


def test_png_checksums():
    png = bytearray(media_png.encode(media_png.padded(b"abc")))
    png[-20] ^= 1
    with pytest.raises(ValueError):
        media_png.decode(bytes(png))
    with pytest.raises(ValueError):
        media_png.decode(b"no")


def test_media_columns(spark, docs, rows, none):
    q = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    got = media_png.with_features(media_png.with_png(q)).collect()
    want = Counter((i, media_png.padded((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, bytes(r.payload)) for r in got) == want
    assert len({(bytes(r.payload), bytes(r.media), bytes(r.dct_hash)) for r in got}) == len({p for _, p in want})
    assert media_png.with_png(none.select("doc_id", F.col("text").alias("data"))).count() == 0
    broken = media_png.with_features(spark.createDataFrame([(1, 3, b"x"), (2, 0, None)], "doc_id long, n_bytes long, media binary"), on_error="null").collect()
    assert all(r.error and r.payload is None for r in broken)


def test_broken_media():
    good = media_png.encode(media_png.padded(b"abc" * 500))
    parts = {k: bytes(b) for k, b in media_png.chunks(good)}
    head, data = parts[b"IHDR"], zlib.decompress(parts[b"IDAT"])
    made = lambda *cs: media_png.SIGNATURE + b"".join(media_png.chunk(k, b) for k, b in [*cs, (b"IEND", b"")])
    whole = zlib.compress(data)
    assert (media_png.decode(made((b"IHDR", head), (b"IDAT", whole[:9]), (b"IDAT", whole[9:]))) == media_png.decode(good)).all()
    for bad in [
        made((b"IHDR", head[:8]), (b"IDAT", whole)),
        made((b"IDAT", whole)),
        made((b"IHDR", head), (b"IHDR", head), (b"IDAT", whole)),
        made((b"IHDR", head), (b"IDAT", whole[:-4])),  # without its checksum
        made((b"IHDR", head), (b"IDAT", whole[:-1] + b"x")),
        made((b"IHDR", head), (b"IDAT", whole + b"x")),
        made((b"IHDR", head), (b"IDAT", zlib.compress(data + bytes(10**7)))),
        made((b"IHDR", head), (b"IDAT", zlib.compress(data[:-1]))),
        made((b"IHDR", b"\xff" * 8 + head[8:]), (b"IDAT", whole)),
        made((b"IHDR", head[:9] + b"\x03" + head[10:]), (b"IDAT", whole)),
    ]:
        with pytest.raises(ValueError):
            media_png.decode(bad)


def test_cosine_hash_by_sums():
    """The hash against the cosine transform written out."""
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (48, 24, 1), dtype=np.uint8)
    small = pixels[:, :, 0].astype(float).reshape(24, 2, 24).mean(axis=1)
    c = lambda k, x: np.cos(np.pi * (2 * x + 1) * k / 48) * np.sqrt((1 if k == 0 else 2) / 24)
    low = [round(sum(c(u, y) * c(v, x) * small[y, x] for y in range(24) for x in range(24)), 6) for u in range(8) for v in range(8)]
    bits = [x > float(np.median(low[1:])) for x in low]
    assert media_png.cosine_hash(pixels) == np.packbits(bits).tobytes()


def test_columns_of_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "s", 5, 6)], "page_id int, url string, _x string, suffix_count int, row int")
    got = url_filters.url_filter(pages, queries.URL_RULES).first()
    assert (got["_x"], got["suffix_count"], got["row"], got["verdict"]) == ("s", 5, 6, "allow")
    docs = spark.createDataFrame([(i, "some words here", "a", i, i, i) for i in range(20)], "doc_id long, text string, source string, _shard long, shard long, copy long")
    out = mixing.shuffled_documents(docs)
    assert out.columns == docs.columns and all(r["_shard"] == r["shard"] == r["doc_id"] for r in out.collect())
    with pytest.raises(ValueError):
        mixing.mixed_documents(docs)


def test_undecodable_ids(spark):
    df = spark.createDataFrame([(1, b"\xff\xff\xff\x7f"), (2, b"abc"), (3, b""), (4, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.bytes for r in bpe_prefix.decoded(df, **RANKS, on_error="null").collect()}
    assert got[1] is None and got[2] is None and got[3] == got[4] == b""


# --- 4, 5 ------------------------------------------------------------------------------------------------------------


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    score = x @ [2.0, -1.0, 0.0] + rng.logistic(size=3000)
    y = np.searchsorted([-1, 0.5, 2], score)
    m = toxicity.CumulativeLink(3, 4).fit(x, y)
    assert (np.diff(m.thresholds) > 0).all() and np.allclose(m.weights, [2, -1, 0], atol=0.25) and np.allclose(m.thresholds, [-1, 0.5, 2], atol=0.25)
    assert (np.diff(m.severity(np.array([[-2, 0, 0], [0, 0, 0], [2, 0, 0]]))) > 0).all()
    row, column = np.nonzero(np.ones_like(x))
    sparse = toxicity.CumulativeLink(3, 4).fit(toxicity.Sparse(row, column, x.ravel(), x.shape), y)
    assert np.allclose(sparse.weights, m.weights) and np.allclose(sparse.thresholds, m.thresholds)


def test_classifiers_held_out(spark):
    d = D.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    quality = [(r.predicted, truth[r.doc_id].quality, r.held_out) for r in queries.op5_pairwise_quality(spark, d).collect() if r.doc_id in truth]
    held = [p == y for p, y, h in quality if h]
    assert sum(held) / len(held) > 0.95


def test_toxicity_held_out(spark):
    d = D.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.learn(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"))
    judged = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), *model).collect()
    tox = [(r.toxic, truth[r.doc_id]) for r in judged if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p for p, y in tox if y == 0) <= 0.01 * len(tox)
    assert sum(p for p, y in tox if y == 1) >= 0.85 * sum(y for _, y in tox) > 50
    few, (index, link) = docs.limit(200).collect(), model
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(few, docs.schema), *model).collect()}
    for d in few:  # the score written out, word by word
        found = toxicity.tokens(d.text)
        score = sum(np.log1p(n) * link.weights[index[w]] for w, n in found.items() if w in index)
        over = [1 / (1 + np.exp(t - score)) for t in link.thresholds]
        assert abs(got[d.doc_id].severity - sum(over)) < 1e-6 and got[d.doc_id].toxic == (over[0] >= link.cut)


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, None, 1), (5, 1, None), (8, 1, 0), (8, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    tox = toxicity.toxicity(docs, *toxicity.learn(docs, labels)).collect()
    assert len(tox) == docs.count() and not any(r.toxic for r in tox) and all(r.severity == 0 for r in tox)
    assert {r.score for r in pairwise_quality.scored(docs, pairwise_quality.learn(docs, labels)).collect()} == {0.5}
    assert toxicity.toxicity(none, *toxicity.learn(none, labels)).count() == 0
    scores = spark.createDataFrame([(i, i / 10) for i in range(10)], "doc_id int, score double")
    assert pairwise_quality.above_quantile(scores, 0.5).count() == 5


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_targets_by_hand():
    got = mixing.targets(np.array([10.0, 100.0, 1000.0]), np.array([5.0, 2.0, 1.0]), 1110.0)
    assert got.tolist() == [30.0, 300.0, 780.0]
    assert mixing.targets(np.array([0.0]), np.array([5.0]), 0.0).tolist() == [0.0]


def test_tree_deals_all_draws():
    out = mixing.split_tree(np.array([500, 3, 70, 0]), 7, np.random.default_rng(1))
    assert out.sum(0).tolist() == [500, 3, 70, 0] and set(out.sum(1).tolist()) == {81, 82}


def test_tree_deals_by_the_hypergeometric_law():
    """Mean and variance of a shard's count of a source, over many seeds."""
    draws, shards = np.array([60, 30, 10]), 4
    got = np.array([mixing.split_tree(draws, shards, np.random.default_rng(s)) for s in range(3000)])
    n, size = draws.sum(), draws.sum() / shards
    for i, k in enumerate(draws):
        mean, var = size * k / n, size * (k / n) * (1 - k / n) * (n - size) / (n - 1)
        for shard in range(shards):
            assert abs(got[:, shard, i].mean() - mean) < 5 * np.sqrt(var / 3000) and abs(got[:, shard, i].var() / var - 1) < 0.15


def test_mixing(docs, rows, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.size * len(r.shards) <= 3 * r.size and all(0 <= s < mixing.SHARDS for s in r.shards)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets(np.array([size[s] for s in order], float), np.array([mixing.WEIGHTS[i % 3] for i in range(len(order))]), float(sum(size.values())))
    assert np.allclose([target[s] for s in order], want)
    largest = defaultdict(int)
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    again = mixing.mixed(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.taken, tuple(r.shards)) for r in got) == Counter((r.doc_id, r.size, r.taken, tuple(r.shards)) for r in again)
    assert mixing.mixed(none).count() == 0
    copies = mixing.mixed_documents(docs)
    assert copies.count() == sum(len(r.shards) for r in got) and copies.columns == [*docs.columns, "_shard", "_copy"]
    assert mixing.shard_rows(mixing.mixed(docs)).count() == copies.count()


# --- 7 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for _, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def families(seed, n, words_each, edits):
    """Bases and copies with some words changed, around the wanted similarity."""
    rnd = random.Random(seed)
    out = []
    for b in range(n):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(words_each)]
        for _ in range(12):
            copy = base[:]
            for _ in range(rnd.randint(0, edits)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randint(0, 10**6)}"
            out.append(" ".join(copy))
        out.append(" ".join(base))
    rnd.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("size", "percent", "length", "edits"), [(3, 90, 12, 2), (3, 90, 150, 8), (5, 80, 150, 12), (5, 80, 400, 20)])
def test_join_families(spark, size, percent, length, edits):
    rows = families(length, 5, length, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(df, size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, size, percent))


def test_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = families(9, 3, 120, 9)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 3, 90))


def test_word_hashes(monkeypatch):
    """One hash a word, wherever it stands, also in texts and words over a piece."""
    rnd = random.Random(6)
    for piece in (ngram_join.PIECE, 40):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        known = {}
        for _ in range(300):
            data = b"".join(bytes(rnd.choices(b"ab\xc3\xa9\x00\xff", k=rnd.choice([0, 1, 2, 5, 37, 38, 39, 40, 41, 90]))) + bytes(rnd.choices(b" \n\t\x0b\x0c\r", k=rnd.randint(0, 3))) for _ in range(rnd.randint(0, 8)))
            hashes = ngram_join.word_hashes(data).tolist()
            assert len(hashes) == len(data.split())
            for w, h in zip(data.split(), hashes, strict=True):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known) > 300


def test_join_edges(docs, rows, none):
    key = lambda x: tuple((v is None, v) for v in x)
    got = ngram_join.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows, 3, 90), key=key)
    assert ngram_join.near_duplicates(none).count() == 0
    left = ngram_join.first_of_each(docs)
    assert left.columns == docs.columns
    want = {i for i, _, c in brute_components(rows, 5, 80) if c == i}
    assert {r.doc_id for r in left.collect()} == want | {None}


def test_tokens_keep_every_partner():
    rng = np.random.default_rng(3)
    for percent in (80, 90):
        ends = ngram_join.bands(percent)
        for n in [1, 2, 5, 9, 10, 11, 19, 20, 50, 200, 1000]:
            for _ in range(8):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                most = len(a) * (100 - percent) // 100
                b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, most + 1))], rng.integers(0, 2**63, int(rng.integers(0, 2)), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and len(a) != both != len(b):
                    (ta, na), (tb, nb) = ngram_join.tokens(a, ends, percent), ngram_join.tokens(b, ends, percent)
                    assert len(np.intersect1d(ta, tb)) >= max(na, nb, 1)


# --- 8, 9 ------------------------------------------------------------------------------------------------------------

RANKS = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@pytest.fixture(scope="module")
def library():
    ranks = bpe_prefix.encoder(**RANKS).vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_library(library):
    e, rnd = bpe_prefix.encoder(**RANKS), random.Random(1)
    tokens = [b.decode() for b in e.vocabulary.ranks if b.isascii()]
    for i in range(3000):
        s = "".join(rnd.choice(tokens) for _ in range(rnd.randint(0, 6))) if i % 2 else "".join(rnd.choice("aabeinost' \n1é😀") for _ in range(rnd.randint(0, 40)))
        ids = e.encode(s)
        assert array("I", ids).tolist() == library.encode_ordinary(s) and e.decode(ids) == s.encode()


def test_bpe_append_and_edit(library):
    rnd = random.Random(5)
    v = bpe_prefix.encoder(**RANKS).vocabulary
    for _ in range(300):
        p = bpe_prefix.Prefixes(v, bytes(rnd.choices(b"abeinorst", k=rnd.randint(0, 12))))
        p.append(bytes(rnd.choices(b"abeinorst", k=rnd.randint(0, 6))))
        a = rnd.randint(0, len(p.data))
        p.edit(a, rnd.randint(a, len(p.data)), bytes(rnd.choices(b"abeinorst", k=rnd.randint(0, 4))))
        assert p.tokens() == library.encode_ordinary(p.data.decode())
        assert p.tokens(a) == library.encode_ordinary(p.data[:a].decode())


def test_bpe_columns(docs, rows, none, library):
    got = bpe_prefix.decoded(bpe_prefix.encoded(docs, **RANKS), **RANKS).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(array("I", bytes(r.ids))), bytes(r.bytes)) for r in got) == want
    assert bpe_prefix.decoded(bpe_prefix.encoded(none, **RANKS), **RANKS).count() == 0
    two, one = bpe_prefix.decoded(bpe_prefix.encoded(docs, **RANKS), **RANKS), bpe_prefix.round_trip(docs, **RANKS)
    assert two.exceptAll(one).isEmpty() and one.exceptAll(two).isEmpty() and one.count() == len(rows)


def test_workers_hold_no_encoder_after_a_task(spark, docs):
    """Workers stay for the tasks of later stages, whose memory would come on top."""

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe_prefix.ENCODERS)] * b.num_rows, pa.int64())], names=["n"])

    bpe_prefix.round_trip(docs, **RANKS).write.format("noop").mode("overwrite").save()
    assert {r.n for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def test_segments():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ds = [rng.integers(0, 2 ** int(rng.integers(1, 33)), int(m), dtype=np.uint64).astype(np.uint32) for m in rng.integers(0, 40, n // 10 + 1)] + [rng.integers(0, 50_000, n).astype(np.uint32)]
        s = token_files.Segment(token_files.pack(ds))
        assert all((a == b).all() for a, b in zip(s.documents(), ds, strict=True))
        if s.n > 20:
            assert (s.ids(7, 19) == np.concatenate(ds)[7:19]).all()
    with pytest.raises(ValueError):
        token_files.Segment(b"x" * 40)


def test_bits_of_blocks():
    rng = np.random.default_rng(5)
    for width in range(33):
        for n in (1, 63, 64, 65, 512):
            x = rng.integers(0, 2**width, (3, n), dtype=np.uint64)
            bits = token_files.packed_bits(x, width)
            plain = ((x[:, :, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(3, -1)
            assert (bits == np.packbits(plain, axis=1, bitorder="little")).all()
            assert (token_files.unpacked_bits(bits, width, n) == x).all()
    for percentile in (0, 50, 95, 100):  # the width fits the percentile, the exceptions are the others
        ids = rng.integers(0, 2**20, 100).astype(np.uint32)
        ids[:5] = 2**32 - 1
        block = token_files.pack_block(ids, percentile)
        low, width, n, far = token_files.BLOCK_HEAD.unpack_from(block)
        rest = np.sort(ids.astype(np.int64) - low)
        assert (low, n, width) == (ids.min(), 100, int(rest[-(-percentile * 99 // 100)]).bit_length()) and far == (rest >> width > 0).sum()
        assert (token_files.unpack_block(block) == ids).all()


def test_token_files(spark, docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(token_files.read(spark, token_files.write(docs, path)).collect(), key=lambda r: r.start)
    ids = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(array("I", bytes(r.ids)))) for r in got) == ids
    assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert token_files.read(spark, token_files.write(none, path)).count() == 0


def test_word_encoder_against_library(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 50)
    path, rnd = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    library, e = Tokenizer.from_file(path), token_files.WordEncoder(path)
    for _ in range(1500):
        t = "".join(chr(rnd.choice([rnd.randint(0, 126), rnd.randint(97, 122), rnd.randint(128, 0x4FF), rnd.randint(0x300, 0x36F), 32, 10, 0x1C, 0x85, 0xA0, 0x130, 73, 46, 39, 115])) for _ in range(rnd.randint(0, 30)))
        t += rnd.choice(["", " <|endoftext|> x<|ENDOFTEXT|>. a<|endoftext|>."])
        assert e.encode([t], 1)[0].tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]
    odd = ["", " ", "J\u030c j\u030c x", "É!!! é\u0301?! ΑΣ. ΣΑ", "a<|b c|> <|ENDOFTEXT|>!", "it's IT'S 'tis x'" * 40, "१२. 12.5% (759)", "\u00a0a\u00a0b. \u3000"]
    for got, t in zip(e.encode(odd, 1), odd, strict=True):
        assert got.tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_suffix_arrays():
    rnd = random.Random(1)
    for _ in range(300):
        t = [rnd.randint(1, rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(0, 60))] + [0]
        assert suffix_dedup.suffix_array(t, max(t) + 1) == sorted(range(len(t)), key=lambda k: t[k:])


def test_repeated_starts():
    rnd = random.Random(2)
    for _ in range(200):
        n, ts = rnd.randint(2, 8), [bytes(rnd.choices(rnd.choice([b"ab", b"abcdefg"]), k=rnd.randint(0, 40))) for _ in range(rnd.randint(1, 5))]
        count = Counter(t[x : x + n] for t in ts for x in range(len(t) - n + 1))
        got = suffix_dedup.repeated_starts([np.frombuffer(t, np.uint8) for t in ts], [-1] * len(ts), [0] * len(ts), [n])
        assert [x.tolist() for x in got] == [[x for x in range(len(t) - n + 1) if count[t[x : x + n]] > 1] for t in ts]


def test_many_shards_at_once():
    rnd = random.Random(3)
    for _ in range(200):
        side = lambda n: bytes(rnd.choices(b"ab", k=rnd.randint(0, n)))
        shards = [(n, [(side(n), side(n)) for _ in range(rnd.randint(1, 5))]) for n in rnd.choices(range(1, 7), k=4)]
        flat = [(g, left, right) for g, (_, rims) in enumerate(shards) for left, right in rims]
        got = suffix_dedup.repeated_starts([np.frombuffer(a + b, np.uint8) for _, a, b in flat], [len(a) for _, a, _ in flat], [g for g, *_ in flat], [n + 1 for n, _ in shards])
        held = [(g, a + b"#" + b) for g, a, b in flat]
        count = Counter((g, t[x : x + shards[g][0] + 1]) for g, t in held for x in range(len(t) - shards[g][0]))
        inside = [{x for x in range(len(t) - shards[g][0]) if x <= len(a) <= x + shards[g][0] and count[g, t[x : x + shards[g][0] + 1]] > 1} for (g, t), (_, a, _) in zip(held, flat, strict=True)]
        assert [{x for x in h.tolist() if x <= len(a) <= x + shards[g][0]} for h, (g, a, _) in zip(got, flat, strict=True)] == inside


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[x : x + length] for d in data for x in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for x in range(len(d) - length + 1):
            if count[d[x : x + length]] > 1:
                gone[x : x + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4096, 2, 1])
def test_removed(spark, docs, rows, none, monkeypatch, limit):
    """The same however often shards are cut."""
    monkeypatch.setattr(suffix_dedup, "MEMBERS", limit)
    got = suffix_dedup.removed(docs).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute_removed([r[1] for r in rows], 400), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0 and suffix_dedup.removed(none).count() == 0


def test_large_shards_are_cut_and_sorted(spark, monkeypatch):
    """A passage in many texts: the rims that agree beyond it are found in shards that were cut."""
    monkeypatch.setattr(suffix_dedup, "MEMBERS", 8)
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    passage, tails = say(390), [say(60) for _ in range(4)]
    rows = [(i, say(200) + tails[i % 4][-rnd.randint(0, 60) :] + passage + tails[-i % 4][: rnd.randint(0, 60)] + say(200)) for i in range(60)]
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: b for (i, _), b in zip(rows, brute_removed([t for _, t in rows], 400), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len({b[1] for b in want.values()}) > 5


@pytest.mark.parametrize(("length", "symbols"), [(400, suffix_dedup.byte_symbols), (51, suffix_dedup.word_symbols)])
def test_ranges_take_little_memory(length, symbols):
    """A worker holds the hashes of a batch of texts several times over; the ranges are those of each text alone."""

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, each, _):  # noqa: N802
            self.each = each
            return self

    rnd = np.random.default_rng(3)
    texts = [bytes(x) for x in rnd.choice(np.frombuffer(b"abcdefgh ", np.uint8), (400, 20_000))]
    ids = pa.array(range(len(texts)), pa.int64())
    each = suffix_dedup.found_ranges(Rows(), length, symbols).each
    tracemalloc.start()
    got = list(each(iter([pa.RecordBatch.from_arrays([ids, ids, pa.array([t.decode() for t in texts])], names=["id", "th", "text"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
    alone = [suffix_dedup.ranges([symbols(t)], length)[0] for t in texts]
    for c in ("s", "e", "p", "whole"):
        assert np.array_equal(np.concatenate([b.column(c).to_numpy() for b in got]), np.concatenate([r[c].view(np.int64) for r in alone]))


def test_rows_alike_and_one_symbol_texts(spark):
    """Rows alike tell their spans once; a text of one symbol tells its windows once."""
    text = "".join(map(str, range(300)))
    rows = [(7, text)] * 2000 + [(8, "a" * 5000), (9, "ab" * 900), (10, "a" * 399), (11, "b" + "a" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.id: len(r.spans) for r in suffix_dedup.repeats(df).collect()}
    assert spans[7] < 60 and spans[8] < 10 and spans[9] < 10
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removed(df).collect()}
    assert got == {7: (len(text), 1), 8: (5000, 1), 9: (1800, 1), 10: (0, 0), 11: (400, 1)}


def test_removed_families(spark):
    rows = families(31, 4, 300, 6) + [(1000 + i, "shared head " * i + "p" * 50 + "".join(map(str, range(200))) + " tail" * i) for i in range(6)]
    got = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {r[0]: b for r, b in zip(rows, brute_removed([r[1] for r in rows], 400), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_clean_documents(spark, docs, none):
    out = suffix_dedup.clean_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert suffix_dedup.clean_documents(none).count() == 0
    assert suffix_dedup.cut_text("aéb", [(0, 2)]) == "éb", "a character that a cut would split stays"
    assert out.where("text is null").count() == docs.where("text is null").count()


def brute_cleaned(texts, length, count):
    """Bytes without those of repeated strings of that length or of runs of words that repeated passages of count words cover."""
    data = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    parts = [[tuple(d[a:b] for a, b in p[i : i + count]) for i in range(len(p) - count + 1)] for d, p in zip(data, places, strict=True)]
    times = Counter(x for p in parts for x in p)
    strings = Counter(d[x : x + length] for d in data for x in range(len(d) - length + 1))
    out = []
    for d, p, found in zip(data, places, parts, strict=True):
        gone = bytearray(len(d))
        marks = ["0"] * len(p)
        for i, x in enumerate(found):
            if times[x] > 1:
                marks[i : i + count] = "1" * count
        spans = [(p[m.start()][0], p[m.end() - 1][1]) for m in re.finditer("1+", "".join(marks))]
        for a, b in spans + [(x, x + length) for x in range(len(d) - length + 1) if strings[d[x : x + length]] > 1]:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(d, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeated_passages(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "MEMBERS", limit)
    rnd = random.Random(8)
    say = lambda n, k=8: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(1, k))) for _ in range(n))
    out = [say(rnd.randint(1, 80)) for _ in range(10)]
    for n, k in [(51, 1), (51, 8), (52, 4), (60, 6), (140, 8), (50, 8), (50, 1), (20, 8)]:
        passage = say(n, k)
        out += [f"{say(rnd.randint(0, 90))} {passage} {say(rnd.randint(0, 90))}" for _ in range(rnd.randint(2, 4))]
    a, b = say(30), say(30)  # twice each, but no passage of 51 words
    out += [f"{say(20)} {a} {b} {say(20)}", f"{say(20)} {a} {say(20)} {b}", "la " * 90, "x" * 500, "x" * 600]
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text.encode() for r in suffix_dedup.clean_documents(df, words=51).collect()}
    assert [got[i] for i in range(len(out))] == brute_cleaned(out, 400, 51)


def test_tokens_of_small_sets():
    """Also where one set gives its empty segments and its partner doesn't."""
    rng = np.random.default_rng(7)
    for percent, least in ((80, 5), (90, 10)):
        ends = ngram_join.bands(percent)
        for _ in range(30_000):
            n = int(rng.integers(least, 21))
            a, most = rng.integers(0, 2**63, n, dtype=np.uint64), n * (100 - percent) // 100
            a, b = np.unique(a * np.uint64(2)), np.unique(a[: n - int(rng.integers(1, most + 1))] * np.uint64(2)) if most else None
            if b is not None and 100 * len(b) >= percent * n:
                (ta, na), (tb, nb) = ngram_join.tokens(a, ends, percent), ngram_join.tokens(b, ends, percent)
                assert len(np.intersect1d(ta, tb)) >= max(na, nb, 1)


def test_join_without_or_with_repeated_ids(spark):
    base = [f"w{i}" for i in range(100)]
    step = lambda n: " ".join([*(f"x{i}" for i in range(n)), *base[n:]])
    other = lambda n: " ".join([*(f"y{i}" for i in range(n)), *(f"z{i}" for i in range(n, 100))])
    rows = [(3, step(0)), (None, step(6)), (4, step(12)), (7, other(0)), (7, other(3)), (None, "alone " * 9), (None, "alone " * 9), (None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, 5, 80).collect())
    assert got == Counter(brute_components(rows, 5, 80)) and got[4, 96, 3] == got[None, 96, 3] == 1
    left = ngram_join.first_of_each(df).collect()
    assert Counter(r.doc_id for r in left) == {3: 1, 7: 1, None: 3} and sum(r.text == "" for r in left) == 2


def test_a_hot_url_does_not_fill_the_sample(spark):
    rnd = random.Random(3)
    urls = [(f"http://h{rnd.randint(10**8, 10**9)}.net.bad/{i}?a=1" if i % 2 else f"http://about.net.good/page{i}") for i in range(200)]
    first = spark.createDataFrame([(u,) for u in urls], "url string").orderBy(F.xxhash64("url"), "url").first().url
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([first] * 300 + urls + ["http://h123456789.net/7?a=1", "http://about.net/page7"])], "page_id int, url string")
    got = {r.url: r.p_block for r in url_filters.url_filter(pages, [("good/", "allow"), ("bad/", "block")], rows=300).where("p_block is not null").collect()}
    assert 0.5 not in got.values(), "both kinds of labels were learned from"
