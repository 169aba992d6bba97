"""The Jaccard join against brute force, and the bounds of its index."""

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from exprstudy.llm import countrtree as rt

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_set(text, width=3):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return {tuple(w[j : j + width]) for j in range(max(len(w) - width + 1, 1 if w else 0))}


def plain_groups(rows, percent=90):
    sets = defaultdict(list)
    for i, text in rows:
        sets[i].append(plain_set(text))
    where = defaultdict(set)
    for i, mine in sets.items():
        if i is not None:
            for s in mine:
                for x in s:
                    where[x].add(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in {(a, b) for ids in where.values() for a in ids for b in ids if a < b}:
        for x in sets[a]:
            for y in sets[b]:
                both = len(x & y)
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    low, high = sorted((top(a), top(b)))
                    parent[high] = low
    return sorted(((i, len(plain_set(t)), top(i)) for i, t in rows), key=str)


def compare(frame, options=rt.Options()):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in rt.groups(frame, options).collect()), key=str)
    want = plain_groups(rows, options.percent)
    assert got == want
    return want


def near_copies(rng, n_words, copies, changes, vocabulary=500):
    base = rng.integers(0, vocabulary, n_words)
    out = []
    for _ in range(copies):
        mine = base.copy()
        spots = rng.integers(0, n_words, int(rng.integers(0, changes + 1)))
        mine[spots] = rng.integers(0, vocabulary, len(spots))
        out.append(" ".join(f"w{x}" for x in mine))
    return out


def test_linked_sets_share_a_file_and_no_bound_is_below_the_overlap():
    rng = np.random.default_rng(1)
    options = rt.Options()
    linked = 0
    for n in [*range(1, 60, 3), 150, 700, 2500]:
        texts = near_copies(rng, n + 2, 12, max(n // 45, 1), 3000)
        texts += [" ".join(t.split()[: int(len(t.split()) * 0.95)]) for t in texts]
        sets, at = rt.shingle_sets(pa.array(texts), 3)
        keys, keys_at = rt.files(sets, at, options)
        where = rt.points(sets, at, options.groups)
        mine = [set(sets[a:b].tolist()) for a, b in zip(at, at[1:])]
        filed = [set(keys[a:b].tolist()) for a, b in zip(keys_at, keys_at[1:])]
        for i in range(len(texts)):
            assert len(mine[i]) == len(plain_set(texts[i])) == where[i].sum()
            for j in range(i):
                both = len(mine[i] & mine[j])
                assert np.minimum(where[i], where[j]).sum() >= both
                if options.may_link(both, len(mine[i]), len(mine[j])) and mine[i] != mine[j]:
                    linked += 1
                    assert filed[i] & filed[j], (n, len(mine[i]), len(mine[j]), both)
    assert linked > 300


def test_empty_parts_are_filed_when_spare_ones_do_not_do():
    """A set whose shingles all fall into few parts still shares a file with its partners."""
    options = rt.Options()
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    keys, at = rt.files(pool, np.array([0, 4000]), options)
    base = np.sort(rng.choice(pool, 100, replace=False))
    for _ in range(200):
        other = np.sort(np.append(base[rng.permutation(100)[:98]], rng.integers(0, 1 << 63, 2, dtype=np.uint64)))
        keys, at = rt.files(np.concatenate([base, other]), np.array([0, 100, 200]), options)
        assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


ODD = [
    (1, "A b c d"),
    (2, "a  B\tc\nd"),
    (3, None),
    (4, ""),
    (5, " \x0b "),
    (6, "one two"),
    (7, "ONE two"),
    (7, "ONE two"),
    (8, "two one"),
    (None, "a b c d"),
    (9, "word " * 50_000),
    (10, "word word word"),
    (11, "x" * 100_000),
    (12, "日本 語 É é"),
]


def test_odd_rows(spark):
    frame = spark.createDataFrame([(*r, "k", 1, "p") for r in ODD], "doc_id bigint, text string, key string, id int, point string").repartition(3)
    compare(frame)
    assert rt.groups(frame.where("doc_id > 1000")).count() == 0


def test_near_copies_chains_and_deep_trees(spark):
    """Groups, chains and pairs just below the similarity, with pages so small that trees have several levels."""
    rng = np.random.default_rng(3)
    texts = near_copies(rng, 200, 60, 8) + near_copies(rng, 60, 30, 3) + near_copies(rng, 900, 12, 30) + near_copies(rng, 15, 30, 1)
    chain = [f"c{i}" for i in range(120)]
    for _ in range(25):
        texts.append(" ".join(chain))
        chain = [*chain[4:], *(f"d{x}" for x in rng.integers(0, 10**6, 4))]
    ids = rng.permutation(len(texts)) + 5
    frame = spark.createDataFrame([(int(i), t) for i, t in zip(ids, texts)], "doc_id bigint, text string").repartition(7)
    want = compare(frame, rt.Options(page=4, fanout=2))
    sizes = defaultdict(int)
    for _, _, c in want:
        sizes[c] += 1
    assert max(sizes.values()) >= 20 and min(sizes.values()) == 1


def test_descent_finds_what_a_scan_finds(spark):
    """Pairs of different components in one file: the tree's are those of all pairs under the bound."""
    rng = np.random.default_rng(4)
    options = rt.Options(groups=8, page=4, fanout=3)
    rows = []
    for key in (1, 2, 3):
        for i in range((150, 40, 2)[key - 1]):
            point = rng.poisson(rng.choice([3, 20, 21, 60]), 8)
            rows.append((key, key * 1000 + i, key * 1000 + i % 30, int(point.sum()), [int(x) for x in point], i % 30 > 0))
    frame = spark.createDataFrame(rows, "key bigint, id bigint, component bigint, n_shingles bigint, point array<int>, stray boolean")
    got = {tuple(r) for r in rt.tree_pairs(frame, options).collect()}
    want = set()
    for k, a, c, n, p, s in rows:
        for k2, b, c2, n2, p2, s2 in rows:
            if k == k2 and a < b and c != c2 and options.may_link(sum(map(min, p, p2)), n, n2):
                want.add((a, b))
    assert got == want and len(want) > 50


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
def test_given_documents(spark):
    compare(spark.read.parquet(f"{FOLDER}/documents.parquet"))
