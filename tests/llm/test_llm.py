"""The corpus operators against plain versions, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, compare
from pyspark.sql import functions as F

from terravane.llm import _spark, _text, bpe, decontam, html, langid, lm, minhash, oracles, quality, queries, rules, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
#: id, text: null, empty, blank, one word, long, equal texts, equal rows, null id
EDGE = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "Alone"), (5, LONG), (6, "Same text here, twice over. É ñ 日本 <|endoftext|> end"), (7, "Same text here, twice over. É ñ 日本 <|endoftext|> end"), (8, "row row row"), (8, "row row row"), (None, "no id"), (9, "a" * 3000), (10, "é　ß\n\n x'll  don't")]
#: names that the operators use inside
CLASH = ["bucket", "first", "n", "key", "rep", "root", "node", "bands", "v", "i", "row", "rare", "token", "__gone", "__place", "score", "stats", "a", "b"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    df = df.select("*", *[F.lit(-1).alias(c) for c in CLASH])
    _spark.ship(spark)
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return _spark.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words(text):
    return WORD.findall((text or "").translate(ASCII))


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    compare(spark, duck, name, queries.QUERIES, oracles.ORACLE_SQL)


def test_word_hashes_name_words():
    texts = ["The cat\tthe CAT", "", "\x0bcat the the", None, "x" * 50]
    h, first = _text.words(*_text.column_bytes(pa.array(texts)))
    flat = [w for t in texts for w in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    names = {}
    assert all(names.setdefault(w, x) == x for w, x in zip(flat, h.tolist(), strict=True)) and len(set(names.values())) == len(names)
    assert _text.word_hash(b"cat") == names["cat"]


def test_word_hashes_over_small_windows(monkeypatch):
    text = [LONG, "tail end"]
    whole = _text.words(*_text.column_bytes(pa.array(text)))[0]
    monkeypatch.setattr(_text, "WINDOW", 64)
    _text._powers.clear()
    assert (whole == _text.words(*_text.column_bytes(pa.array(text)))[0]).all()
    _text._powers.clear()


def test_hash_table_finds_all_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    t = _text.HashTable(keys, np.arange(5000))
    assert (t.get(keys) == np.arange(5000)).all() and (t.get(keys + np.uint64(1)) == -1).all()
    assert (_text.HashTable(keys[:0], np.arange(0)).get(keys) == -1).all()


# --- 1


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def hard_texts():
    rng = random.Random(4)
    parts = ["a", "b ", " ", "\n", "é", "ñ ", "  ", "12", "'s", "!", "　", "日本", "<|endoftext|>", "\t", "word "]
    return ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 50, 700, 3000, 3000, 6000)] + ["x" * 4000, " " * 4000, "　 " * 1500, ("shared passage of some length. " * 40) + "tail"]


def test_chunked_encoding_is_exact():
    codec = bpe.Codec(bpe.load_vocabulary(queries.tokenizer_path()), chunk_bits=6, min_chunk=16)
    texts = hard_texts()
    for text, want in zip(texts, reference_ids(texts), strict=True):
        ids = codec.encode(text.encode())
        assert ids.tolist() == want and codec.decode(ids) == text
    assert codec.reused > 0


def test_joins_are_widened_until_they_agree(monkeypatch):
    codec = bpe.Codec(bpe.load_vocabulary(queries.tokenizer_path()), chunk_bits=6, min_chunk=16)
    texts = [*hard_texts(), "no-blank-at-all" * 500, LONG[:9000], "日本語の文章です。" * 300]
    want = reference_ids(texts)
    assert [codec.encode(t.encode()).tolist() for t in texts] == want and codec.widened == 0
    codec, plain = bpe.Codec(bpe.load_vocabulary(queries.tokenizer_path()), chunk_bits=7, min_chunk=150), codec.plain
    # a stretch that is not wide enough comes out wrong at first
    monkeypatch.setattr(codec, "seam", lambda data: plain(data)[::-1] if len(data) < 60 else plain(data))
    want = reference_ids([LONG[:9000]])[0]
    assert codec.encode(LONG[:9000].encode()).tolist() == want and codec.widened > 5
    # stretches that never agree: the whole text is encoded
    monkeypatch.setattr(codec, "seam", lambda data: plain(data)[::-1])
    assert codec.encode(LONG[:9000].encode()).tolist() == want


def test_store_of_chunks_is_bounded():
    codec = bpe.Codec(bpe.load_vocabulary(queries.tokenizer_path()), store_bytes=50_000)
    for k in range(300):
        codec.encode((f"text {k} " * 100).encode())
    assert codec.young_bytes <= 60_000 and len(codec.old) < 300


def test_encoding_edge_cases_and_round_trip(spark, edge):
    texts = [t or "" for _, t in EDGE]
    want = collections.Counter((i, hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for (i, _), x, t in zip(EDGE, reference_ids(texts), texts, strict=True))
    got = bpe.encode_digests(edge, queries.tokenizer_path()).collect()
    assert collections.Counter((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    back = bpe.decode_documents(bpe.encode_documents(edge, queries.tokenizer_path()), queries.tokenizer_path())
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((i, t or "") for i, t in EDGE)
    assert bpe.encode_digests(edge.limit(0), queries.tokenizer_path()).count() == 0


# --- 2


@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards_are_a_gapless_permutation(spark, edge, n):
    out = sharding.shard_documents(edge, n, bucket_bytes=1000).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(EDGE)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_repeat_and_depend_on_the_seed(docs):
    def place(seed):
        return {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs, 4, seed).collect()}

    assert place(1) == place(1) != place(2)
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


def test_very_many_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_COPIES", 20)
    given = [(7, "the same row")] * 900 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(400)]
    df = spark.createDataFrame(given, "doc_id long, text string")
    _spark.ship(spark)
    records, n = sharding.scatter(df, 1000, 5, "doc_id", "text")
    sizes = collections.Counter(r["bucket"] for r in records.collect())
    assert n == 1600 and sum(sizes.values()) == n and max(sizes.values()) < 60
    out = sharding.shard_documents(df, 7, bucket_bytes=1000).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(given)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_fisher_yates_is_uniform():
    counts = collections.Counter(tuple(sharding.fisher_yates(3, 5, k)) for k in range(6000))
    assert len(counts) == 6 and min(counts.values()) > 850


# --- 3


def base_scores(rows):
    train = collections.Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in [*words(t), None])
    n, v = sum(train.values()), len(train)
    return n, [(i, len(words(t)) + 1, sum(train[w] > 0 for w in [*words(t), None]), sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])) for i, t in rows]


@pytest.mark.parametrize("table", [1 << 19, 50])
def test_base_scores_are_exact(spark, docs, rows, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    n, want = base_scores(rows)
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert len(got) == len(rows)
    for i, size, known, base in want:
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n) and abs(r["base_score"] - base) < 1e-6 * abs(base)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and r["score"] < 0


def test_scores_of_edge_cases(edge):
    n, want = base_scores(EDGE)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in lm.score_documents(edge).collect())
    assert got == collections.Counter((i, s, k, round(b, 6)) for i, s, k, b in want)
    assert lm.score_documents(edge.limit(0)).count() == 0


def small_vocabulary(n=300, side=8):
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 2**63, n, dtype=np.uint64)
    counts = np.sort(rng.integers(1, 500, n))[::-1]
    half = side * side // 2
    bucket = (tokens >> np.uint64(20)).astype(np.int64) % half
    return tokens, counts, lm.Vocabulary(tokens, counts, int(counts.sum()), n, side, (np.bincount(bucket, counts, half), np.bincount(bucket, minlength=half)))


def test_model_probabilities_sum_to_one():
    tokens, counts, vocab = small_vocabulary()
    rng = np.random.default_rng(7)
    model = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in lm.start_model(vocab).items()}
    ids = vocab.outputs(tokens, vocab.index(tokens))
    for context in ((64, 64), (3, 64), (40, 7)):
        lp = lm.log_probabilities(model, vocab.side, np.arange(64), *(np.full(64, c) for c in context))
        assert abs(np.exp(lp).sum() - 1) < 1e-4
        # all known tokens, and one unknown token for each shared output
        own = ids < vocab.half
        share = np.where(own, 1, (counts + lm.SMOOTH) / 10 ** vocab.share[np.where(own, 0, ids - vocab.half)])
        assert abs((np.exp(lp)[ids] * share).sum() + (np.exp(lp[vocab.half :]) * lm.SMOOTH / 10**vocab.share).sum() - 1) < 1e-4


def test_contrastive_training_learns_a_pattern():
    vocab = lm.Vocabulary(np.arange(1, 4, dtype=np.uint64), np.array([100, 100, 100]), 300, 3, 4, (np.r_[300, np.zeros(7)], np.r_[3, np.zeros(7)]))
    ids = vocab.outputs(tokens := np.tile(np.arange(1, 4, dtype=np.uint64), 4000), vocab.index(tokens))
    given = lm.samples(*lm.padded(ids, np.array([0, len(ids)]), 16))
    assert all(len(x) == 12000 for x in given) and given[1][:2].tolist() == [16, ids[0]] and given[2][:3].tolist() == [16, 16, ids[0]]
    trainer = lm.Trainer(lm.start_model(vocab), vocab)
    for k in range(60):
        trainer.learn(k, *given)
    one = np.array([ids[1]])
    assert lm.log_probabilities(trainer.model, 4, one, np.array([ids[0]]), np.array([ids[2]]))[0] > np.log(0.8)


@pytest.mark.parametrize("table", [1 << 19, 40])
def test_scores_equal_a_plain_recomputation(spark, docs, rows, monkeypatch, table):
    monkeypatch.setattr(lm, "TABLE", table)
    held = docs.withColumn("held_out", _spark.held_out(F.col("doc_id"), 10, 0)).select("doc_id", "text", "held_out")
    fitted = lm.fit(held.filter("not held_out").select("doc_id", "text"))
    m, vocab = {k: v.astype(float) for k, v in fitted.model.items()}, fitted.vocabulary.value
    count = {np.uint64(r["token"] % 2**64): r["n"] for r in fitted.counts.collect()}
    side, half = vocab.side, vocab.half
    top = sorted(count, key=lambda k: (-count[k], k))
    own = {k: i for i, k in enumerate(x for x in top[:half] if count[x] >= fitted.limit)}
    place = {k: own.get(k, half + (int(k) >> 20) % half) for k in count}
    mass = np.zeros(half)
    for k, n in count.items():
        if k not in own:
            mass[place[k] - half] += n + lm.SMOOTH
    mass += lm.SMOOTH
    for r in lm.score(held, fitted).collect()[:60]:
        text = next(t for i, t in rows if i == r["doc_id"])
        tokens = [np.uint64(_text.word_hash(w.encode())) for w in words(text)] + [lm.END]
        ids = [side * side] * 2 + [place.get(k, half + (int(k) >> 20) % half) for k in tokens]
        total = 0.0
        for at, k in enumerate(tokens, 2):
            v = m["C1"][ids[at - 1]] + m["C2"][ids[at - 2]]
            o, s = ids[at], m["U"] @ v + m["d"]
            a = o // side
            q = m["Q"][a * side : a * side + side] @ v + m["b"][a * side : a * side + side]
            total += (s[a] - np.log(np.exp(s).sum()) + q[o % side] - np.log(np.exp(q).sum())) / np.log(10)
            if o >= half:
                total += math.log10(count.get(k, 0) + lm.SMOOTH) - math.log10(mass[o - half])
        assert abs(total - r["score"]) < 1e-4 * abs(total) + 1e-3


def test_the_model_does_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 10_000)
    train = docs.select("doc_id", "text").limit(120)
    train = _spark.materialise(train)
    one, two = (lm.fit(x).model for x in (train.coalesce(1), train.repartition(7, F.rand(3))))
    assert all(np.allclose(one[k], two[k], atol=1e-5) for k in one) and not np.allclose(one["Q"], lm.start_model(small_vocabulary(side=int(len(one["Q"]) ** 0.5))[2])["Q"])


def test_the_threshold_of_the_table_is_exact(spark):
    rng = random.Random(3)
    for given in ([5] * 30, [3_000_000_000 + rng.randrange(4) for _ in range(40)], [int(1.5**k) for k in range(60)], [rng.randrange(1, 40) for _ in range(300)], []):
        counts = spark.createDataFrame([(k, n) for k, n in enumerate(given)], "token long, n long")
        for most in (1, 10, 40, 1000):
            limit = lm.threshold(counts, most)
            assert sum(n >= limit for n in given) <= most
            assert limit == 1 or sum(n >= limit - 1 for n in given) > most


def test_model_beats_the_base_on_held_out_text(spark):
    out = lm.score_documents(_spark.table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out")
    score, base = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


# --- 4


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return {i: find(i) for i in sets}


def near_copies(seed, groups=6, size=14, n=80):
    """Groups of edited copies, also chains in which only neighbours are close."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        text = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for k in range(size):
            rows.append((g * 100 + k, " ".join(text)))
            source = text if g % 2 else text[:]
            for _ in range(rng.randrange(1, 4)):
                source[rng.randrange(n)] = f"x{rng.randrange(3000)}"
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    given = near_copies(width)
    sets = sets_of(given, width)
    want = {i: (len(sets[i]), c, c == i) for i, c in components(sets).items()}
    df = spark.createDataFrame(given, "doc_id long, text string")
    _spark.ship(spark)
    rows = minhash.near_duplicates(df, width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == want and len(rows) == len(given)


def test_near_duplicate_edge_cases(edge):
    got = minhash.near_duplicates(edge, 2).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by[r["doc_id"]] = r
    assert all(by[i]["n_shingles"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3))
    assert by[4]["n_shingles"] == 1 and by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"]
    assert by[8]["component_id"] == 8 and by[8]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    left = collections.Counter(r["doc_id"] for r in minhash.drop_near_duplicates(edge, 2).collect())
    assert left == {i: 1 for i, _ in EDGE if i != 7}
    assert minhash.drop_near_duplicates(edge, 2).columns == edge.columns
    assert minhash.near_duplicates(edge.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(edge, 2, percent=70)


def large_pairs(seed, n=14, size=600):
    """Pairs of large sets whose similarity is close to 0.8: equal in size, or one inside of the other."""
    rng, rows = random.Random(seed), []
    for g in range(n):
        text = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        keep = 0.8 + rng.choice([-0.012, -0.004, 0.004, 0.012])
        if g % 2:
            other = text[: round(size * keep)]
        else:
            shared = round(size * 2 * keep / (1 + keep))
            other = text[:shared] + [f"x{rng.randrange(10**6)}" for _ in range(size - shared)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("leaders", [64, 1])
def test_large_sets_close_to_the_limit_equal_brute_force(spark, monkeypatch, leaders):
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    given = large_pairs(leaders)
    # members that share a passage with all of a bucket, but are far from each other, end up in its rounds
    given += [(i + 100, t) for i, t in large_pairs(leaders + 1, 4, 300)]
    want = components(sets_of(given, 2))
    df = spark.createDataFrame(given, "doc_id long, text string")
    _spark.ship(spark)
    got = minhash.near_duplicates(df, 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(given)


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    """Bands of one row make large buckets of documents that are far from each other."""
    monkeypatch.setattr(minhash, "LEADERS", 2)
    given = near_copies(5, groups=8, size=8, n=40)
    sets = sets_of(given, 2)
    sketch = minhash.sketch
    monkeypatch.setattr(minhash, "sketch", lambda df, width: sketch(df, width, 240, 1))
    passage = " ".join(f"common{k}" for k in range(25))
    given = [(i, f"{passage} {t}") for i, t in given]
    sets = sets_of(given, 2)
    df = spark.createDataFrame(given, "doc_id long, text string")
    _spark.ship(spark)
    got = minhash.near_duplicates(df, 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(sets) and len(got) == len(given)


def test_rows_that_share_an_id(spark):
    text = [f"w{k}" for k in range(60)]
    given = [(1, " ".join(text)), (1, "another text of the same id"), (2, " ".join(text[:-1])), (3, "alone with some words")]
    _spark.ship(spark)
    runs = []
    for rows in (given, given[::-1]):
        out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
        runs.append(sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out))
    assert runs[0] == runs[1] and len(runs[0]) == 4
    left = minhash.drop_near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), 2)
    assert [r["text"] for r in left.filter("doc_id = 1").collect()] == ["another text of the same id"]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    s = minhash.signatures(minhash.sigma(np.concatenate([base, other])), np.array([0, 1000, 2000]), 240)
    assert abs((s[:, 0] == s[:, 1]).mean() - 800 / 1200) < 0.12


def test_components_of_chains(spark):
    edges = spark.range(100).selectExpr("id AS a", "id + 1 AS b")
    assert {r["root"] for r in minhash.connected_components(edges).collect()} == {0}


# --- 5


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_table():
    rng = random.Random(2)
    for _ in range(60):
        a = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 25))])
        assert decontam.smith_waterman(a, b)[0] == plain_alignment(a.tolist(), b.tolist())


def test_leaks_equal_brute_force(spark, docs, rows):
    bench = _spark.table(spark, SF, "benchmark")
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    want = set()
    for (i, t), (m, q) in itertools.product(rows, items.items()):
        w = words(t)
        if len(set(q) & set(w)) >= 0.4 * len(set(q)) and len(w) < 3000 and plain_alignment(q, w) >= decontam.THRESHOLD * 2 * len(q):
            want.add((i, m))
    long = {i for i, t in rows if len(words(t)) >= 3000}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    assert {x for x in got if x[0] not in long} == want and want
    clean = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in got}


def test_leaks_in_edited_copies_and_edge_cases(spark, edge):
    item = [f"item{k} of the" for k in range(12)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "tiny"), (4, "")], "item_id long, text string")
    edited = " ".join(item).split()
    edited[5], edited[20] = "changed", "other"
    del edited[11]
    given = [(1, "before " + " ".join(edited).upper() + " after"), (2, "nothing of the kind of the sort"), (3, None), (4, " ".join(item)), (4, " ".join(item)), (5, "a tiny thing")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect())
    assert got[1, 1] == 1 and got[4, 1] == 2 and not any(i in (2, 3) for i, _ in got) and got[5, 3] == 1
    short = spark.createDataFrame([(1, "Two words"), (2, "one"), (None, "of the sort")], "item_id long, text string")
    many = spark.createDataFrame([(1, "one two words here, two  WORDS"), (2, "words two"), (3, "one"), (4, "two"), (None, "kind of the sort")], "doc_id long, text string")
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(many, short).collect()) == {(1, 1): 2, (1, 2): 1, (3, 2): 1, (None, -1): 1}
    assert decontam.find_leaks(edge, bench).count() == 0
    assert decontam.drop_contaminated(edge, bench).columns == edge.columns
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench, block_bytes=10).count() == decontam.find_leaks(df, bench).count()


def test_an_item_in_every_document_is_found(spark):
    text = "one very common passage that stands in each and every text of the corpus"
    df = spark.createDataFrame([(i, f"start{i} {text} end{i}") for i in range(50)], "doc_id long, text string")
    _spark.ship(spark)
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert decontam.find_leaks(df, bench).count() == 50 and decontam.drop_contaminated(df, bench).count() == 0


def test_an_item_that_leaked_often_is_found_by_its_tail(spark):
    item = [f"item{k}" for k in range(40)]
    edited = [f"other{k}" if k % 3 == 1 and k <= 19 else w for k, w in enumerate(item)]
    given = [(i, f"start{i} {' '.join(item)} end{i}") for i in range(6)] + [(6, " ".join(edited))]
    df = spark.createDataFrame(given, "doc_id long, text string")
    _spark.ship(spark)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.find_leaks(df, bench).collect()}
    assert set(got) == set(range(7)) and got[6] == plain_alignment(item, edited) / (2 * len(item)) >= decontam.THRESHOLD
    assert decontam.drop_contaminated(df, bench).count() == 0


def test_each_copy_in_a_window_is_a_row(monkeypatch):
    item = [f"item{k}" for k in range(40)]
    items = decontam.Items([7], [" ".join(item)], 3)
    items.prepare()
    # a stray seed between the copies joins their windows
    text = " ".join(item + ["a"] * 30 + item[18:21] + ["b"] * 30 + item)
    given = _text.words(*_text.column_bytes(pa.array([text, "none", text])))
    for held in (decontam.HITS, 1):
        monkeypatch.setattr(decontam, "HITS", held)
        out = decontam._align(items, *given, decontam.THRESHOLD)
        assert sorted(zip(out["text"], out["end"], out["score"], strict=True)) == [(0, 40, 1.0), (0, 143, 1.0), (2, 40, 1.0), (2, 143, 1.0)]


# --- 6


def plain_measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(g)
    covered = {p for k, x in enumerate(g) if often[x] > 1 for p in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_on_edge_cases(edge):
    got = rules.quality_rules(edge).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter((r["doc_id"], *[r[c] for c in names]) for r in got) == collections.Counter((i, *plain_measures(t)) for i, t in EDGE)
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert rules.quality_rules(edge.limit(0)).count() == 0


def test_rules_run_no_python(edge):
    plan = rules.quality_rules(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- 7


def test_archive_round_trip(spark):
    body = "<p>é日本</p>" + "x" * 200
    given = [(1, "http://a b/", "<p>1</p>"), (2, "u", body), (3, "u", body), (4, None, None), (5, "u", ""), (6, "u", "line\r\n\r\nWARC/1.1\r\n" * 3000), (2, "u", body), (7, "u", "<p>1</p>"), (8, "v", "0\r\n\r\n" * 40), (8, "w", "0\r\n\r\n" * 40)]
    df = spark.createDataFrame(given, "page_id long, url string, html string").select("*", *[F.lit(0).alias(c) for c in CLASH])
    _spark.ship(spark)
    got = warc.round_trip(df).collect()
    first = {}
    for i, _, h in sorted(given, key=lambda x: x[0]):
        first.setdefault(h or "", i)
    want = collections.Counter()
    for i, _, h in given:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h] != i
        want[i, "revisit" if again else "response", first[h] if again else None, len(b), hashlib.sha256(b).hexdigest()] += 1
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {(h or "").encode() for _, _, h in given}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_rows_without_an_id_are_archived(spark):
    body, other = "x" * 200, "y" * 200
    given = [(None, "u", body), (None, "u", body), (7, "v", body), (9, "v", body), (None, "u", other), (None, "w", "short"), (None, None, None)]
    _spark.ship(spark)
    got = warc.round_trip(spark.createDataFrame(given, "page_id long, url string, html string")).collect()
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == {(None, "revisit", 7, 200): 2, (7, "response", None, 200): 1, (9, "revisit", 7, 200): 1, (None, "response", None, 200): 1, (None, "response", None, 5): 1, (None, "response", None, 0): 1}


def test_many_equal_payloads_meet_by_a_shuffle(spark, monkeypatch):
    given = [(k, f"u{k}", "hot payload " * 20 if k % 2 else f"pair {k // 4} " * 20 if k % 4 else "") for k in range(400)]
    given += [(k + 1000, "u", f"pair {k % 100} " * 20) for k in range(150)]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    _spark.ship(spark)

    def out():
        return sorted((r["page_id"], r["record_type"], r["refers_to"] or -1, r["payload_bytes"]) for r in warc.round_trip(df).collect())

    want = out()
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "HOT", 8)
    assert out() == want and sum(r[1] == "revisit" for r in want) > 250


def _read_back(spark, folder, records):
    import gzip

    folder.mkdir()
    (folder / "a.gz").write_bytes(gzip.compress(b"".join(records)))
    return warc.read_warc(spark, str(folder)).collect()


def test_segments_missing_doubled_or_swapped_are_refused(spark, tmp_path):
    payload = bytes(range(33, 120)) * 80
    parts = list(warc.records_of(1, 0, "u", payload, hashlib.sha256(payload).hexdigest(), None, 1000))
    _spark.ship(spark)
    rows = _read_back(spark, tmp_path / "whole", parts[::-1])
    assert [(r["page_id"], bytes(r["payload"])) for r in rows] == [(1, payload)]
    swapped = [p.replace(b"Segment-Number: 2\r", b"Segment-Number: X\r").replace(b"Segment-Number: 3\r", b"Segment-Number: 2\r").replace(b"Segment-Number: X\r", b"Segment-Number: 3\r") for p in parts]
    for name, given in {"first": parts[1:], "last": parts[:-1], "inner": parts[:2] + parts[3:], "doubled": [*parts, parts[2]], "swapped": swapped}.items():
        with pytest.raises(Exception, match="is not complete|another digest|chunk without|invalid literal|not found"):
            _read_back(spark, tmp_path / name, given)


def test_segments_are_checked(spark, tmp_path):
    whole = b"".join(warc.records_of(1, 0, "u", b"y" * 5000, hashlib.sha256(b"y" * 5000).hexdigest(), None, 1000))
    records = list(warc.parse(whole))
    assert len(records) > 3 and [int(f["WARC-Segment-Number"]) for f, _ in records] == list(range(1, len(records) + 1))
    assert warc.unchunked(warc.chunked("é".encode() * 5000, 7)) == "é".encode() * 5000
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-3]))


# --- 8


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = _spark.table(spark, sf, "labels")
    out = quality.score_documents(_spark.table(spark, sf, "documents"), labels).join(labels, "doc_id").filter("held_out")
    right, n = out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    assert n > 1000 and right > 0.97


def plain_statistics(text):
    data = (text or "").encode()
    n = max(1, len(data))
    out = [math.sqrt(sum(c in k for c in data) / n) for k in quality.BYTE_CLASSES]
    out.append(math.sqrt(sum(not any(c in k for k in quality.BYTE_CLASSES) for c in data) / n))
    w = [x.encode() for x in WORD.findall(text or "")]
    low = [x.lower() for x in w]  # bytes: A-Z only
    m, row = len(w), [0.0] * 11
    row[0] = math.log1p(m) / 10
    if m:
        size = [len(x) for x in w]
        row[1], row[2] = np.mean(size) / 10, np.std(size) / 10
        row[3], row[7] = np.mean([x <= 3 for x in size]), min(max(size), 200) / 50
        row[4], row[5] = len(set(low)) / m**0.9, max(collections.Counter(low).values()) / m
        row[6] = np.mean([65 <= x[0] <= 90 for x in w])
        pairs = list(itertools.pairwise(low)) or low
        row[8] = len(set(pairs)) / len(pairs)
        lines = data.split(b"\n")
        row[9], row[10] = len(set(lines)) / len(lines), math.log1p(m / len(lines)) / 5
    return out + row


def test_scores_equal_a_plain_regression(spark, docs, rows):
    labels = {r["doc_id"]: r["quality"] for r in _spark.table(spark, SF, "labels").collect()}
    x = {i: np.array(plain_statistics(t), np.float32).astype(float) for i, t in rows}
    width = len(next(iter(x.values())))
    assert width == quality.N_STATS
    for (i, t), got in zip(rows, quality.statistics(pa.array([t for _, t in rows])), strict=True):
        assert np.allclose(got, x[i], atol=1e-6)
    train = [i for i in x if labels.get(i) is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    apart = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(4)) == 0).collect()}
    a = np.array([x[i] for i in train])
    centre, scale = a.mean(0), a.std(0) + 1e-3
    rng = np.random.default_rng(11)
    directions, phase = rng.normal(0, math.sqrt(2 * quality.GAMMA), (width, quality.WIDTH)), rng.uniform(0, 2 * math.pi, quality.WIDTH)

    def features(v):
        return np.append(math.sqrt(2 / quality.WIDTH) * np.cos(np.clip((v - centre) / scale, -8, 8) @ directions + phase), 1)

    fitted = [i for i in train if i not in apart]
    z, y = np.array([features(x[i]) for i in fitted]), np.array([float(labels[i]) for i in fitted])
    # ridge as least squares with rows for the penalty
    penalty = math.sqrt(quality.RIDGE * len(fitted) / quality.WIDTH)
    beta = np.linalg.lstsq(np.vstack([z, penalty * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    raw = {i: float(features(v) @ beta) for i, v in x.items()}
    bins = {i: int(np.clip((r + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1)) for i, r in raw.items()}
    seen = collections.defaultdict(list)
    for i in train:
        if i in apart:
            seen[bins[i]].append(labels[i])
    at = sorted(seen)
    # isotonic fit by its minimax formula
    w, s = [len(seen[k]) for k in at], [sum(seen[k]) for k in at]
    level = [max(min(sum(s[i : j + 1]) / sum(w[i : j + 1]) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, _spark.table(spark, SF, "labels")).collect()}
    close = sum(abs(got[i] - np.interp(bins[i], at, level)) < 1e-6 for i in x)
    assert set(got) == set(x) and close >= 0.99 * len(x)  # a raw score on the edge of a bin may fall to either side


def test_fitting_is_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 30)
    labels = _spark.table(spark, SF, "labels")
    assert 5 < quality.known_labels(labels).count() < 60
    assert quality.score_documents(docs, labels).count() == docs.count()


def test_classifier_edge_cases(spark, edge):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (8, 1)], "doc_id long, quality int")
    got = quality.score_documents(edge, labels).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    flat = quality.score_documents(edge, labels.limit(0)).collect()
    assert {r["score"] for r in flat} == {0.5}
    assert quality.score_documents(edge.limit(0), labels).count() == 0
    assert quality.keep_good(edge, labels.limit(0)).count() == len(EDGE)


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    labels = _spark.table(spark, SF, "labels")
    held = _spark.held_out(F.col("doc_id"), 3, 1)
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality.score_documents(docs, x).collect())) for x in (labels, other))
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(one, two, strict=True))


def test_isotonic_is_the_least_squares_fit():
    got = quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([3.0, 1, 2, 5]))
    assert np.allclose(got, [2, 2, 2, 5]) and (np.diff(got) >= 0).all()


# --- 9

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no no no no no";</script></head><body class="post">
<header class="site-header"><a href="/">Home page of the site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, as all sites do, to serve you better and better</div>
<main><article><header><h1>The &amp; Title</h1></header><p>First   paragraph with\n several words in it.<p>Second &lt;one&gt; with <b>bold</b><br>text &eacute; here.
<div class="ad">Buy this now, it is cheap and good</div><ul><li>Point one is long enough<li>Point two is as well</ul>
<aside>Related things to read</aside><form><input><button>Send it</button> your mail here</form><p>Last paragraph, with a <a href=x>link</a> in it.</p></article></main>
<section id="comments"><p>Reader says that this is a very long comment about the article at hand</p></section><div class="sidebar"><p>Side words here</p></div>
<footer>Copyright by somebody and all rights reserved</footer></body></html>"""


def test_article_is_extracted_without_its_surroundings():
    seen = html.label_counts(PAGE)
    for weights in ({}, html.weights(seen)):
        assert html.extract(PAGE, weights) == "The & Title\nFirst paragraph with several words in it.\nSecond <one> with bold text é here.\nPoint one is long enough\nPoint two is as well\nLast paragraph, with a link in it."


def test_best_region_equals_all_regions():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.randrange(-5, 6) for _ in range(rng.randrange(1, 12))]
        a, b = html.best_region(s)
        assert sum(s[a:b]) == max(0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))


def test_pages_and_edge_cases(spark):
    pages = _spark.table(spark, SF, "pages")
    for r in html.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        import html as std

        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "just words"), (None, "u", "<p>a b c</p"), (5, "u", "<script>"), (5, "u", "<" * 500), (6, "u", "<!-- x <p>y</p>")], "page_id long, url string, html string")
    got = html.extract_pages(odd.select("*", F.lit(1).alias("n"), F.lit(2).alias("side"))).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
    assert by[1] == [""] and by[2] == [""] and by[3] == [""] and by[4] == ["just words"] and by[None] == ["a b c"] and by[6] == [""] and len(by[5]) == 2
    assert html.extract_pages(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def learned():
    import duckdb

    seen = collections.Counter()
    for (page,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall():
        seen.update(html.label_counts(page or ""))
    return html.weights(seen)


def test_scan_and_learned_weights_decide(learned, monkeypatch):
    import duckdb

    pages = [p for (p,) in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    want = [html.extract(p, learned) for p in pages]
    with monkeypatch.context() as m:  # no list of names is needed where pages are labelled
        m.setattr(html, "listed", lambda name: False)
        assert [html.extract(p, learned) for p in pages] == want
        # a class that no list knows is learned to be no content
        other = [p.replace('class="ad"', 'class="zq17"') for p in pages]
        seen = collections.Counter()
        for p in other:
            seen.update(html.label_counts(p))
        assert [html.extract(p, html.weights(seen)) for p in other] == want
    monkeypatch.setattr(html, "best_region", lambda scores: (0, len(scores)))
    assert sum(html.extract(p, learned) != w for p, w in zip(pages, want, strict=True)) > len(pages) / 2


TEXT = "These are the words of a paragraph that is long enough to be the text of a page."


@pytest.mark.parametrize("name", ["side-effects", "search-results", "form-of-government", "alert-levels-explained"])
def test_compound_names_are_no_hints(learned, name):
    page = f'<body><p>{TEXT}</p><div class="{name}"><p>Second. {TEXT}</p></div><p>Third. {TEXT}</p></body>'
    for weight in ({}, learned):
        assert html.extract(page, weight) == f"{TEXT}\nSecond. {TEXT}\nThird. {TEXT}"


def test_pages_without_article_or_main(learned):
    page = f"""<body><div><a href=/>Home</a> | <a href=/a>About us</a> | <a href=/b>Shop</a> | <a href=/c>Help</a></div>
    <ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><div id="wrap"><h2>Title of it</h2><p>{TEXT}<ul><li>{TEXT}<li>{TEXT}</ul>
    <div class="comment-list"><p>Some reader wrote this</p></div><div class="site-footer">All rights reserved</div></div><span>x</span></body>"""
    for weight in ({}, learned):
        assert html.extract(page, weight) == f"Title of it\n{TEXT}\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize("tag", ["svg", "select", "object", "math", "canvas", "textarea", "noscript"])
def test_unclosed_elements_keep_the_rest(learned, tag):
    page = f"<body><p>{TEXT}</p><div><{tag} id=x></div><p>{TEXT}</p></body>"
    inner = f"<body><p>{TEXT}</p><{tag}><p>{TEXT}</p></body>"
    for weight in ({}, learned):
        assert html.extract(page, weight) == html.extract(inner, weight) == f"{TEXT}\n{TEXT}"


# --- 10


def test_automaton_accepts_exactly_the_substrings():
    text = np.array([0, 1, 0, 0, 1, 2, 0, 1])
    go = langid.suffix_automaton(text, 3)
    have = {tuple(text[i:j]) for i in range(8) for j in range(i + 1, 9)}
    for n in range(1, 5):
        for s in itertools.product(range(3), repeat=n):
            state = 0
            for c in s:
                state = go[state, c] if state >= 0 else -1
            assert (state >= 0) == (s in have)


def plain_phrases(lang_text, text):
    total = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in lang_text:
            j += 1
        total, i = total + 1, j
    return total


@pytest.mark.parametrize("stretch", [192, 7, 1])
def test_phrases_equal_a_plain_parse_of_whole_texts(monkeypatch, stretch):
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = random.Random(stretch)
    samples = {"aa": b"abab abba babb aab" * 3, "bb": b"xyxy yxx zzy abx" * 3, "cc": b"a" * 400 + b"b"}
    parser = langid.Parser(samples)
    texts = ["abab xyxy qq", "zzyx" * 120, "a", "", "ab ba " * 90, "a" * 900, "aab" * 250]
    texts += ["".join(rng.choice(["ab", "xy", " ", "zzy", "q", "aaaaaaa", "babb"]) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    low, new = langid.symbols(*_text.column_bytes(pa.array(texts)))
    counts = parser.phrases(new, low)
    for k, lang in enumerate(parser.languages):
        own = bytes(langid.symbols(np.array([0, len(samples[lang])]), np.frombuffer(samples[lang], np.uint8))[0]).decode()
        assert counts[k].tolist() == [plain_phrases(own, bytes(low[new[t] : new[t + 1]]).decode()) for t in range(len(texts))]


def test_languages_are_normalised_and_ties_go_by_name():
    rng = random.Random(6)
    vocabulary = {lang: ["".join(rng.choice("abcdefghij" if lang == "xx" else "hijklmnopq") for _ in range(rng.randrange(2, 7))) for _ in range(60)] for lang in ("xx", "yy")}
    sample = {"xx": " ".join(rng.choice(vocabulary["xx"]) for _ in range(3000)).encode(), "yy": " ".join(rng.choice(vocabulary["yy"]) for _ in range(60)).encode(), "zz": b""}
    texts = [" ".join(rng.choice(vocabulary[lang]) for _ in range(40)) for lang in ("xx", "yy")]
    assert langid.identify(pa.array(texts), sample)[0] == ["xx", "yy"]
    assert langid.identify(pa.array(["word"]), {"bb": b"other text", "aa": b"other text"})[0] == ["aa"]


def test_languages_on_held_out_rows(spark):
    d = _spark.table(spark, "/root/testdata/sf0.1", "documents")
    out = langid.identify_documents(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99


def test_language_edge_cases(spark, edge):
    got = {r["doc_id"]: r for r in langid.identify_documents(edge).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3)) and got[5]["lang_pred"] == "en" and 0 < got[5]["score"] <= 1
    digits = spark.createDataFrame([(1, "123 ### 456", "en"), (2, "word", None), (3, "日本", "en"), (4, "the words of a text", "en")], "doc_id long, text string, lang string")
    by = {r["doc_id"]: r["lang_pred"] for r in langid.identify_documents(digits).collect()}
    assert by == {1: "und", 2: "en", 3: "en", 4: "en"}
    none = langid.identify_documents(digits.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.keep_identified(digits).count() == 3 and langid.keep_identified(edge).columns == edge.columns
    assert langid.identify_documents(edge.limit(0)).count() == 0


# --- pipeline


def test_pipeline_equals_its_stages_done_plainly(spark, docs, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "decontamination", "bpe_encoding"]
    left = docs
    names = docs.columns
    bench = _spark.table(spark, SF, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        left = _spark.materialise(stage(spark, left, SF))
        assert left.columns == names
        after = {r["doc_id"] for r in left.collect()}
        given = spark.createDataFrame(list(before.items()), "doc_id long, text string")
        if name == "quality_classifier":
            good = {r["doc_id"] for r in quality.score_documents(given, _spark.table(spark, SF, "labels")).filter("predicted = 1").collect()}
            assert after == good
        if name == "language_id":
            assert after == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        if name == "near_dedup":
            assert after == {i for i, c in components(sets_of(list(before.items()), 5)).items() if i == c}
        if name == "decontamination":
            assert after == set(before) - {r["doc_id"] for r in decontam.find_leaks(given, bench).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == after
    assert {(r["doc_id"], r["decoded_sha256"]) for r in got} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in before.items() if i in after}


def test_stages_on_edge_cases(spark, edge, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    for name, schema, given in (("labels", "doc_id long, quality int, toxic int", [(5, 1, 0), (6, 1, 0), (9, 0, 0), (10, 1, 0), (None, 1, 0)]), ("benchmark", "item_id long, text string", [(1, "twice over. É ñ"), (2, None)])):
        spark.createDataFrame(given, schema).write.parquet(f"{folder}/{name}.parquet")
    given = edge.select("*", F.lit("x").alias("DOCID"), F.lit(1).alias("lang_pred"))
    for docs in (given, given.limit(0)):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = _spark.materialise(stage(spark, left, folder))
            assert kept.columns == given.columns and kept.count() <= left.count()
            own = collections.Counter(map(tuple, left.collect()))
            assert all(own[r] >= n for r, n in collections.Counter(map(tuple, kept.collect())).items())
            if name == "language_id" and docs is given:
                assert not any(r["doc_id"] in (1, 2, 3) for r in kept.collect())
            left = kept
        out = corpus_pipeline.STAGES[-1][1](spark, left, folder)
        assert out.count() == left.count()
        # each stage also runs on the whole of the rows
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() <= docs.count()
    docs = given.select("doc_id", "text", "lang", "source")
    docs.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registered_queries_cover_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert json.dumps(sorted(oracles.ORACLE_SQL))
