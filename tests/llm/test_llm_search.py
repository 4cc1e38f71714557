"""Ranked search, spelling groups and exact top-k: SQL, brute force and odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import differences, oracle_connection
from llm_helpers import DOCS, docs_frame

from barlake.llm import queries, ranked_search, sliced_index, spelling_groups

ITEMS = "item_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert not differences(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], oracle_connection(sf_dir))


# ranked search


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain_search(docs, items, k=50):
    tfs = [(d, Counter(plain_terms(t))) for d, t in docs]
    df = Counter(term for _, tf in tfs for term in tf)
    n_docs, n_terms = sum(bool(tf) for _, tf in tfs), sum(tf.total() for _, tf in tfs)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item].update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, tf in tfs:
            m = 50 + 50 * tf.total() * n_docs // max(1, n_terms)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if tf[t]
            )
            if score and doc is not None:
                scored.append((-score, doc))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_ranked_search_against_brute_force_over_shards(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "日本語", "x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((0, 3, 30, 200))))) for i in range(2600)]
    items = [(i, "-".join(rng.choices(words, k=rng.choice((1, 5, 60))))) for i in range(17)]
    want = plain_search(docs, items)
    frames = docs_frame(spark, docs), spark.createDataFrame(items, ITEMS)
    assert rows_of(ranked_search.search(*frames)) == want
    # many shards and blocks of items; then one shard of several windows
    assert rows_of(ranked_search.search(*frames, shard_bytes=9_000, block_items=3)) == want
    assert rows_of(ranked_search.search(frames[0].coalesce(1), frames[1])) == want
    assert rows_of(ranked_search.search(*frames, k=3)) == plain_search(docs, items, 3)


def test_ranked_search_skips_windows_and_lists(spark):
    """A late document that no list's bound lets in is never looked at, and results stay those of all."""
    looked = []

    class Watched(ranked_search.Shard):
        def _window(self, w, *rest):
            looked.append(w)
            return super()._window(w, *rest)

    texts = [(b"rare " * 5 + b"common", i) if i < 60 else (b"common " + b"filler%d " % (i % 3), i) for i in range(5000)]
    batch = ranked_search._shard(0, [i for _, i in texts], [t for t, _ in texts])
    import pyarrow as pa

    rows = pa.Table.from_batches([batch])
    rows = rows.append_column("w", pa.array([0 if t == b"" else 9000 if t == b"rare" else 3 for t in rows["term"].to_pylist()], pa.int64()))
    terms = rows["term"].to_pylist()
    shard = Watched(rows, 5000, 5000 * 3)
    ids, scores = shard.best([terms.index(b"rare"), terms.index(b"common")], 50)
    assert looked == [0] and sorted(ids.tolist()) == list(range(50)) and (scores > 0).all()


def test_ranked_search_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,! "), (None, "alpha beta"), (4, "Alpha"), (5, "alpha"), (5, "alpha"), (6, "gamma " * 300_000 + "delta"), (7, "ALPHA\x00beta\x7fgamma")]
    items = [(1, "alpha"), (1, "beta"), (2, None), (3, "--"), (None, "alpha"), (4, "delta epsilon"), (9, "epsilon"), (10, "gamma")]
    assert rows_of(ranked_search.search(docs_frame(spark, docs), spark.createDataFrame(items, ITEMS))) == plain_search(docs, items)
    none = spark.createDataFrame([], DOCS)
    assert rows_of(ranked_search.search(none, spark.createDataFrame(items, ITEMS))) == []
    assert rows_of(ranked_search.search(docs_frame(spark, docs), spark.createDataFrame([], ITEMS))) == []


# spelling groups


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def plain_groups(docs):
    words = plain_words(docs)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=str)


def test_spelling_groups_against_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeéÀß", k=rng.randint(6, 11))) for _ in range(120)]
    words = []
    for w in base:
        words += [w] * rng.choice((1, 2, 30, 400))
        for _ in range(rng.randint(0, 12)):
            i, kind = rng.randrange(len(w)), rng.randrange(4)
            v = w[:i] + (["", rng.choice("abcÿ"), w[i] + rng.choice("abé"), w[i:i + 2][::-1]][kind]) + w[i + (2 if kind == 3 else 1):]
            words += [v] * rng.choice((2, 3, 25))
    rng.shuffle(words)
    docs = [(i, " ".join(words[at:at + 50])) for i, at in enumerate(range(0, len(words), 50))]
    found = sorted(map(tuple, spelling_groups.group(docs_frame(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert found == plain_groups(docs) and any(r[1] and r[2] != r[1] for r in found)


def test_every_edit_shares_a_signature(spark):
    words = ["abcdefg", "aaaaaaaa", "éßÀyzab"]
    alphabet = "abgzéÀ"
    pairs = set()
    for w in words:
        for i in range(len(w) + 1):
            pairs |= {(w, w[:i] + c + w[i:]) for c in alphabet} | {(w, w[:i] + c + w[i + 1:]) for c in alphabet if i < len(w)}
    long = "abcdefghij" * 8  # compared without an edit-distance table
    pairs |= {(long, long[:i] + c + long[i + k:]) for i in (0, 1, 40, 79, 80) for c in ("", "z", "é") for k in (0, 1)}
    known = sorted({w for p in pairs for w in p})
    frame = spark.createDataFrame([(w, 2) for w in known], "word string, n long")
    found = {tuple(sorted((r.a, r.b))) for r in spelling_groups.near_pairs(frame).collect()}
    assert found == {(a, b) for a in known for b in known if a < b and one_edit(a, b)}


def test_spelling_groups_odd_rows(spark):
    long = "ab" * 100_000
    docs = [
        (1, None), (2, ""), (None, "nothing nothing"), (3, f"{long} {long}x {long} {long}x"), (4, "Chain " * 3), (5, "lettersÉ LETTERSÉ lettersé"), (5, "lettersÉ LETTERSÉ lettersé"),
    ]
    docs += [(6, "windowsx " * 2 + "windowsxx " * 40 + "windowsxxy " * 900)]
    found = sorted(map(tuple, spelling_groups.group(docs_frame(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert found == plain_groups(docs)
    assert spelling_groups.group(spark.createDataFrame([], DOCS)).collect() == []


# exact top-k


def plain_top(vectors, k=10):
    out = []
    for q, asked in vectors.items():
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(asked, v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(asked))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, score double, dims int, part string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, 3, "x") for i, v in rows], VECTORS)


def whole(v):
    return [math.floor(1024 * x) for x in v]


@pytest.mark.parametrize("values", [sliced_index.BLOCK_VALUES, 700])
def test_sliced_index_against_brute_force(spark, values):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    rows += [(i, rows[3][1]) for i in range(900, 1000)]  # ties by the hundred
    rows += [(1000 + i, (rng.normal(size=16) * 10.0**rng.integers(-4, 4)).tolist()) for i in range(120)]
    rows += [(2000 + i, rng.integers(-3, 3, 5).astype(float).tolist()) for i in range(130)]
    found = rows_of(sliced_index.search(vector_frame(spark, rows), F.col("vec_id") % 100 == 0, block_values=values, query_rows=5))
    assert found == plain_top({i: whole(v) for i, v in rows})


def test_slices_add_and_select(spark):
    rng = np.random.default_rng(3)
    numbers = rng.integers(-900, 900, (500, 7)).astype(np.int32)
    block = sliced_index.SlicedBlock(np.arange(500), numbers)
    query = np.array([3, -700, 0, 511, -1, 64, 12], np.int64)
    true = numbers.astype(np.int64) @ query
    slices, lowest, left_out, constant = block.sums(query, 0.0)
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little")[:500] for s in slices]).astype(np.int64)
    sums = (bits << np.arange(len(slices))[:, None]).sum(axis=0)
    assert lowest == left_out == 0 and (sums + constant == true).all()
    for k in (1, 10, 499, 500, 501):
        value = block.kth_largest(slices, block.rows, k)
        assert value == (np.sort(sums)[-k] if k <= 500 else 0)
        reached = np.unpackbits(block.at_least(slices, block.rows, value).view(np.uint8), bitorder="little")[:500]
        assert (reached.astype(bool) == (sums >= value)).all()
    slices, lowest, left_out, constant = block.sums(query, 0.05)
    bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little")[:500] for s in slices]).astype(np.int64)
    under = true - constant - ((bits << np.arange(len(slices))[:, None]).sum(axis=0) << lowest)
    assert lowest > 0 and under.min() >= 0 and under.max() <= left_out


def test_sliced_index_odd_rows(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (100, [0.0, 0.0]), (200, [-1.0, 1e-9]), (300, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, [1.0]), (5, [2.0]), (500, [3.0]), (None, [1.0, 1.0]),
        (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (600, []), (9, [40_000.0, 1.0]), (10, [-32_767.9, 32_767.9]), (11, [5.0, 5.0]), (11, [4.0, 9.0]), (11, [4.0, 9.0]), (0, [1.0, 2.0]),
    ]
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and abs(x) < 32_768 for x in v):
            kept[i] = min(kept.get(i, whole(v)), whole(v))
    found = rows_of(sliced_index.search(vector_frame(spark, rows), F.col("vec_id") % 100 == 0))
    assert found == plain_top(kept)
    assert rows_of(sliced_index.search(vector_frame(spark, []), F.col("vec_id") % 100 == 0)) == []
