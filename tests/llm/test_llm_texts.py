"""Text operators against plain versions, on odd rows and on the smallest given tables."""

import re
import zlib
from collections import Counter, defaultdict

import hashlib
import math
import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exprstudy.llm import bpe, catalogue, grammar, htmltext, langid, linealign, neardup, packing, permindex, pieces, quality, suffixtree
from exprstudy.llm import textops as tx
from exprstudy.session import durable

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}

PARA = "the quick brown fox jumps over the lazy dog and runs far away from here today"
TEXTS = [
    (1, PARA + "\n" + "second line of this text has ten words in it ok"),
    (2, PARA + "\n" + "second line of this text has ten words in it ok"),
    (3, PARA + "\n\n" + "another ending that is not like the first one at all"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one two"),
    (7, "one two"),
    (None, "no id but words"),
    (8, "word " * 60_000),
    (9, "x" * 100_000),
    (10, "Größe ÀÉ 日本語 '▁' don't   end\r\n"),
    (11, "12345 ### $$$"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with columns whose names operators use themselves."""
    clash = "block string, hash int, place string, part int, band string, kept string, component string, _c0 int, lang string"
    rows = [(i, t, "b", 1, "p", 2, "x", "no", "c", 0, "en" if i and i % 2 else None) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + clash)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id > 1000")


@pytest.fixture(scope="module")
def given(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("given tables are not here")
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def texts_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


# --- text helpers ----------------------------------------------------------


def test_words_lines_and_hashes():
    texts = [t for _, t in TEXTS if t is not None] + ["a\n\nb\n", "\n", "é\x0bz"]
    data, offsets = tx.buffer(pa.array([None, *texts, ""]))
    starts, ends, at = tx.words(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate([None, *texts, ""]):
        got = [raw[a:b].decode() for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])]
        assert got == words(text)
    first, last, line_at = tx.lines(data, offsets)
    for i, text in enumerate([None, *texts, ""]):
        got = [raw[a:b].decode() for a, b in zip(first[line_at[i] : line_at[i + 1]], last[line_at[i] : line_at[i + 1]])]
        assert got == (text or "").split("\n")
    hashes = dict()
    for h, a, b in zip(tx.hash_words(data, starts).tolist(), starts, ends):
        assert hashes.setdefault(raw[a:b], h) == h
    assert len(set(hashes.values())) == len(hashes)


# --- op1 -------------------------------------------------------------------


def plain_base(rows):
    train = Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2 or i is None:
            train.update(w.translate(LOWER) for w in words(text))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, text in rows:
        tokens = [w.translate(LOWER) for w in words(text)] + [None]
        score = sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((i, len(tokens), sum(train[t] > 0 for t in tokens), n, round(score, 4)))
    return sorted(out, key=str)


def held_out():
    return F.coalesce(catalogue.remainder(7) == 2, F.lit(False))


@pytest.mark.parametrize("table", ["odd", "given"])
def test_base_scores(request, table):
    frame = request.getfixturevalue(table)
    got = suffixtree.scores(frame, held_out()).collect()
    plain = [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]
    assert sorted(plain, key=str) == plain_base(texts_of(frame))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("folder", [FOLDER, FOLDER.replace("0.001", "0.01")])
def test_scores_beat_the_base_on_held_out_texts(spark, folder):
    """Over known words and ends, where both scores speak of the same outcomes: the base has one outcome for all unknown words, the model spells them."""
    if not os.path.isdir(folder):
        pytest.skip("given tables are not here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    train = {w.translate(LOWER) for i, t in texts_of(docs) if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t)}
    rows = suffixtree.scores(docs, held_out(), apart=True).where("held_out").collect()
    unknown = -math.log10(rows[0].train_tokens + len(train) + 2)
    base = sum(r.base_score - (r.n_tokens - r.n_known) * unknown for r in rows)
    assert sum(r.score - r.unknown_score for r in rows) > base


def test_unknown_spellings_share_what_known_ones_leave(spark):
    """The probabilities of the known words, and of all two-letter words that are not known, leave no mass twice."""
    known = ["aa", "ab", "ba", "aab"]
    ids = [i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    probe = [i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 == 2]
    texts = [(i, known[k % 4] if k < 36 else f"once{k}") for k, i in enumerate(ids)]
    new = [x + y for x in "abc" for y in "abc" if x + y not in known] + ["a", "b", "c", "aaa", "abb"]
    texts += [*zip(probe, [*known, *new, *(f"once{k}" for k in range(36, 40)), ""])]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in suffixtree.scores(frame, held_out()).collect()}
    first = {t: 10 ** got[i] for i, t in texts if i in set(probe)}
    total = sum(first.values())
    assert 0.5 < total <= 1 + 1e-9


def test_unknown_words_pay_for_their_spelling(spark, given):
    """Held-out gibberish has a lower score per token than held-out text, and long unknown words a lower one than short."""
    ids = [i for i in range(10**9, 10**9 + 100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    odd = [(ids[0], "xqzjv kqwpz vvxqj zzkqx " * 20), (ids[1], "xqzjvkqwpzvvxqj zzkqxqjvvzpwqk " * 20)]
    rows = given.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string"))
    got = suffixtree.scores(rows, held_out(), apart=True).where("held_out").collect()
    per = {r.doc_id: r.score / r.n_tokens for r in got}
    text = sum(r.score for r in got if r.doc_id not in ids) / sum(r.n_tokens for r in got if r.doc_id not in ids)
    assert per[ids[1]] < per[ids[0]] < text
    assert all(r.score - 1e-6 <= r.unknown_score <= 0 for r in got)


def plain_tree(texts, scored, n_symbols, discount=0.75, divergence=10.0):
    """Scores of texts of repeated words with contexts of up to two words, kept from two occurrences on."""
    after = defaultdict(Counter)
    for text in texts:
        for i, w in enumerate(text):
            for d in range(min(i, 2) + 1):
                after[tuple(text[i - d : i])][w] += 1

    def gain(context):
        here, parent = after[context], after[context[1:]]
        total, up = sum(here.values()), sum(parent.values())
        left = {w: max(n - 1 - discount, 0) + discount * len(here) * parent[w] / up for w, n in here.items()}
        return sum(n * math.log(left[w] / (total - 1) / (parent[w] / up)) for w, n in here.items())

    kept = {c for c in list(after) if c and sum(after[c].values()) > 1 and gain(c) >= divergence}
    kept |= {c[1:] for c in kept} | {()}
    out = []
    for text in scored:
        log = 0
        for i, w in enumerate(text):
            p = 1 / n_symbols
            for d in range(min(i, 2) + 1):
                context = tuple(text[i - d : i])
                if context not in kept:
                    break
                total = sum(after[context].values())
                p = discount * len(after[context]) / total * p + max(after[context][w] - discount, 0) / total
            log += math.log10(p)
        out.append(log)
    return out, kept


def test_rare_contexts_are_states(spark):
    """The word tree is that of the plain version in one block and in many; a context below 1 in 10,000 words teaches."""
    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 60, 30_000)] for _ in range(8)]
    texts += [["alpha", f"w{i % 7}", "beta", "gamma", "delta", "omega"] * 2 for i in range(8)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    new = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    probe = ["w1", "beta", "gamma", "delta", "omega", "alpha"]
    rows = [*zip(ids, map(" ".join, texts)), (new, " ".join(probe))]
    want, kept = plain_tree([[*t, None] for t in texts], [[*t, None] for t in [*texts, probe]], len({w for t in texts for w in t}) + 2)
    assert ("beta", "gamma") in kept or ("gamma",) in kept
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for split in (frame.coalesce(1), frame.repartition(6)):
        got = {r.doc_id: r.score for r in suffixtree.scores(split, held_out()).collect()}
        assert [got[i] for i in [*ids, new]] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_runs_of_positions_change_nothing(spark, given, depth, monkeypatch):
    """Contexts with more positions than a run, split by longer contexts, score as in one go; so do more parts."""
    options = suffixtree.Options(word_depth=depth)
    rows = given.select("doc_id", "text").unionByName(spark.createDataFrame([(10**9 + i, "very common pair " * 300) for i in range(9)], "doc_id bigint, text string"))
    want = {r.doc_id: r[5:] for r in suffixtree.scores(rows, held_out(), options, apart=True).collect()}
    monkeypatch.setattr(suffixtree, "RUN_TOKENS", 40)
    monkeypatch.setattr(suffixtree, "LEAST_PARTS", 3)
    got = {r.doc_id: r[5:] for r in suffixtree.scores(rows, held_out(), options, apart=True).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)


def test_tree_without_contexts(spark):
    """At depth 0 every position has its symbol's discounted share."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    frame = spark.createDataFrame([*zip(ids, ["a b a", "b a", ""])], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in suffixtree.scores(frame, held_out(), suffixtree.Options(word_depth=0)).collect()}
    a, b, end = (math.log10(0.75 * 3 / 8 / 4 + (n - 0.75) / 8) for n in (3, 2, 3))
    assert [got[i] for i in ids] == pytest.approx([2 * a + b + end, a + b + end, end])


def test_cells_come_back():
    rng = np.random.default_rng(9)
    rows = rng.integers(0, [[3], [4], [1 << 31]], (3, 500))
    rows = list(rows[:, np.lexsort(rows[::-1])])
    steps = suffixtree._steps(rows)
    assert all((a == b).all() for a, b in zip(suffixtree._rows(steps), rows))
    columns = [*steps, np.array([], np.int64), np.array([7, 255], np.uint8), np.array([-0.5, 1e300]), np.array([0, 1 << 40]), np.array([-1, 5]).view(np.uint64)]
    back = suffixtree._expand(suffixtree._squeeze(*columns))
    assert all((a.view(np.uint8) == b.view(np.uint8)).all() for a, b in zip(back, columns))


@pytest.mark.skipif(not os.path.isdir(FOLDER.replace("0.001", "0.01")), reason="given tables are not here")
def test_tables_of_the_tree_stay_near_the_size_of_the_texts(spark, monkeypatch):
    """What the query leaves in the shared folder; rows of all contexts took many times the texts."""
    written = []
    monkeypatch.setattr(suffixtree, "durable", lambda *given: written.append(durable(*given)) or written[-1])
    docs = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/documents.parquet")
    suffixtree.scores(docs, held_out()).count()
    size = lambda frame: sum(os.path.getsize(urlparse(path).path) for path in frame.inputFiles())
    assert 0 < sum(map(size, written)) < 2 * size(docs)


def test_scores_of_nothing(empty):
    assert suffixtree.scores(empty, held_out()).count() == 0


def test_tree_is_a_distribution(spark):
    """After every history the probabilities of all symbols sum to 1."""
    rng = np.random.default_rng(3)
    flat = rng.integers(0, 4, 4000)
    flat[1::2] = (flat[::2] + 1) % 4
    counts = []
    for d in range(3):
        for i in range(d, len(flat)):
            key = sum(int(flat[i - k]) << (8 * (k - 1)) for k in range(1, d + 1)) | d << 56
            counts.append((key, int(flat[i]), 1))
    frame = spark.createDataFrame(counts, "context bigint, symbol int, n bigint")
    tree = suffixtree.grow(frame, len(flat), 8, 2, 4, 1e-3, suffixtree.Options())
    assert len(tree.states) > 1
    for history in ([], [0], [3], [1, 2], [2, 2]):
        ends = [np.array([*history, x], np.uint64) for x in range(4)]
        p = [suffixtree.probabilities(tree, e, np.arange(len(e)), 0)[-1] for e in ends]
        assert sum(p) == pytest.approx(1)


# --- op2 -------------------------------------------------------------------


def plain_groups(rows):
    sets = {}
    for i, text in rows:
        w = [x.translate(LOWER) for x in words(text)]
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1 if w else 0))}
    where = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            where[x].add(i)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    return {(i, len(sets[i]), top(i), top(i) == i) for i in sets}


def test_groups_equal_brute_force(given):
    got = {tuple(r) for r in neardup.groups(given).collect()}
    assert got == plain_groups(texts_of(given))


def test_groups_of_odd_rows(odd, empty):
    rows = neardup.groups(odd).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].component_id == 1 and not by_id[2].kept
    assert by_id[3].component_id == 3
    assert by_id[4].n_shingles == by_id[5].n_shingles == by_id[6].n_shingles == 0 and by_id[5].kept
    assert by_id[7].n_shingles == 1 and by_id[8].n_shingles == 1
    assert by_id[None].component_id is None and by_id[None].kept
    assert neardup.groups(empty).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, 10, 11, None], key=str)


def test_chain_and_hot_group(spark):
    """A chain is one component; many near copies of one text are too, whichever bucket leads."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        for j in rng.choice(120, 2, replace=False):
            text[j] = f"own{i}_{j}"
        rows.append((i, " ".join(text)))
    chain = [f"c{i}" for i in range(200)]
    for k in range(6):
        rows.append((1000 + k, " ".join(chain[: 100] if k == 0 else chain[8 * k : 100 + 8 * k])))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in neardup.groups(frame).collect()}
    assert got == plain_groups(rows)


def test_estimates_follow_similarity(spark):
    options = neardup.Options()
    a = " ".join(f"w{i}" for i in range(1000))
    rows = [(0, a), (1, a.replace("w500 ", "zz ")), (2, " ".join(f"w{i}" for i in range(120, 1120))), (3, " ".join(f"v{i}" for i in range(900)))]
    s = neardup.sketches(spark.createDataFrame(rows, "doc_id bigint, text string"), options)
    one = s.where("doc_id = 0").select(F.col("signature").alias("s0"))
    found = {r.doc_id: r.e for r in s.crossJoin(one).select("doc_id", neardup.estimate("signature", "s0", options).alias("e")).collect()}
    assert found[0] == 1 and found[1] > 0.9 and abs(found[3]) < 0.1
    assert abs(found[2] - 876 / 1116) < 0.13


# --- op3 -------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>One<li>Two<ul><li>Deep</ul><li>Three</ul>", "- One\n- Two\n  - Deep\n- Three"),
        ("<ol start=9><li>x<li>y</ol>", " 9. x\n10. y"),
        ("<table><tr><th>Name<th>Value<tr><td>a<td>1<tr><td>longer name<td>2</table>", "Name         Value\na            1\nlonger name  2"),
        ("<table><tr><td colspan=2>wide cell here<tr><td>a<td>b</table>", "wide cell here\na  b"),
        ("a<script>no()</script> <b hidden>no</b><i style='DISPLAY : none'>no</i>b", "a b"),
        ("<head><title>t</title></head><body>x &lt;&amp; y < z", "x <& y < z"),
        ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
        ("one<br>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<!-- no --><p>yes<!-- open", "yes"),
        ("<td>loose</td></p>x", "loose\n\nx"),
        ("", ""),
    ],
)
def test_layout(page, text):
    assert htmltext.extract(page)[1] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ('<table><tr><td width=10">Visible</td><td class="a">B</td></table>', "Visible  B"),
        ("<p title=it's>Hello world</p><p>Second</p>", "Hello world\n\nSecond"),
        ('<p class="a"">x</p><p \'>y</p>', "x\n\ny"),
        ('<p title = "a > b" id=x"y>z</p>', "z"),
        ("<p title='a > b'hidden>no</p><i a=>b</i>", "b"),
        ('<b style="display:none">no</b><p a="x>lost', ""),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
        ("<svg>no<title>no</title><defs><text>no</text></defs><g><text>Axis <tspan>one</tspan></text><text>Two</text></g></svg>z", "Axis one\nTwo\nz"),
        ("<p>Size: <select><option disabled>no<option>S<optgroup label=no><option>M<option selected>L</select> ok", "Size: L ok"),
        ("<p>Size: <select><option disabled>no<option>S<option>M</select> ok", "Size: S ok"),
        ("<select multiple><optgroup label=G><option>S<option label=M>no</select>", "G\nS\nM"),
    ],
)
def test_visible_text_of_odd_pages(page, text):
    assert htmltext.extract(page)[1] == text


def test_titles_and_broken_tags():
    assert htmltext.extract("<svg><title>no</title></svg><p>x")[0] == ""
    assert htmltext.extract("<p " + "a=\"'" * 200_000)[1] == ""


def test_pages(spark):
    rows = [(1, "<title>A  b</title><p>x"), (2, None), (3, ""), (1, "<title>A  b</title><p>x"), (4, "<div>" * 20_000 + "deep")]
    frame = spark.createDataFrame([(i, h, "t", "u") for i, h in rows], "page_id bigint, html string, text string, title string")
    got = sorted(((r.page_id, r.title, r.text) for r in htmltext.texts(frame).collect()), key=str)
    assert got == sorted([(1, "A b", "x"), (1, "A b", "x"), (2, None, None), (3, "", ""), (4, "", "deep")], key=str)
    assert htmltext.texts(frame.where("page_id > 9")).count() == 0


# --- op4 -------------------------------------------------------------------


def plain_nearest(rows, k=10):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in good:
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, s) for s, i in found]
    return out


def test_recall_and_order(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("given tables are not here")
    frame = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    exact = plain_nearest([(r.vec_id, list(r.embedding)) for r in frame.collect()])
    found = defaultdict(list)
    for r in permindex.search(frame, F.col("vec_id") % 100 == 0, permindex.Options(least=20)).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert found.keys() == exact.keys()
    hits = [len({i for i, _ in found[q]} & {i for i, _ in exact[q]}) / 10 for q in exact]
    assert np.mean(hits) >= 0.9
    for q, rows in found.items():
        assert [s for _, s in rows] == sorted(s for _, s in rows)
        assert all(s == dict(exact[q]).get(i, s) for i, s in rows)


def unlike_rows(kind, n=2_000, width=256, seed=3):
    """Wide rows, whose orders of pivots tell little of distances; with far queries, and far from zero."""
    values = np.random.default_rng(seed).normal(size=(n, width))
    if kind == "far queries":
        values[::100] *= 20
    elif kind == "offset":
        values += 1e6
    return [(i, [float(v) for v in row]) for i, row in enumerate(values)]


@pytest.mark.parametrize("kind", ["wide", "far queries", "offset"])
def test_nearest_are_found_on_unlike_rows(spark, kind):
    rows = unlike_rows(kind)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = defaultdict(list)
    for r in permindex.search(frame, F.col("vec_id") % 100 == 0, permindex.Options(least=20)).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert dict(found) == plain_nearest(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, []), (100, [0.0, 2.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, shard int, block int")
    got = [tuple(r) for r in permindex.search(frame, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    exact = plain_nearest(rows)
    assert got == [(q, n + 1, i, s) for q in sorted(exact) for n, (i, s) in enumerate(exact[q])]
    assert permindex.search(frame.where("vec_id > 1000"), F.col("vec_id") % 100 == 0).count() == 0


# --- op5, op6, op9 ---------------------------------------------------------

ODD_STRINGS = [t for _, t in TEXTS if t is not None] + [
    "'s ''s !'s don't DON'T 'll're", "İ ſ Ως", "á é", "\r\n\r\n  x\t\ty  ", "aaaa ababab", "　x　", "<|endoftext|>", "\x00\x1c\x1f", "\U0001F600 1¼2²",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_the_tokenizers_library(name, given):
    file = bpe.LibraryFile(catalogue.tokenizer(name))
    texts = ODD_STRINGS + [t or "" for _, t in texts_of(given)]
    ids, at = file.encode(pa.array(texts))
    expected = [e.ids for e in file.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == expected


def test_ids_of_the_sentencepiece_library(given):
    file = bpe.PieceFile(catalogue.tokenizer("piece_bpe_32k.model"))
    texts = ODD_STRINGS + [t or "" for _, t in texts_of(given)]
    ids, at = file.encode(pa.array(texts))
    expected = file.library.encode(texts, add_bos=True, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == expected
    data, where = file.decode(ids, at)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(where[:-1], where[1:])] == file.library.decode(expected)


def test_merge_order_with_lower_rank_after_a_merge():
    """Merging a b may bring up a pair that ranks before a b; then only the leftmost one is merged."""
    table = bpe.PairTable(np.array([0, 2]), np.array([1, 0]), np.array([5, 1]), np.array([2, 3]), 4)
    got, lengths = bpe.merge(np.array([0, 1, 0, 1]), np.array([4]), table)
    assert got.tolist() == [3, 1] and lengths.tolist() == [2]


def test_piece_digests(odd, empty):
    path = catalogue.tokenizer("piece_bpe_32k.model")
    lib = bpe.piece_file(path).library

    def sha(raw):
        return hashlib.sha256(raw).hexdigest()

    expected = []
    for i, t in TEXTS:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        expected.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode())))
    assert sorted(map(str, (tuple(r) for r in pieces.digests(odd, path).collect()))) == sorted(map(str, expected))
    decoded = pieces.decode(pieces.encode(odd, path), path).collect()
    assert sorted(str((r.doc_id, r.text)) for r in decoded) == sorted(str((i, (t or "").replace("▁", " "))) for i, t in TEXTS)
    assert pieces.digests(empty, path).count() == 0


def library_ids(name, text):
    return bpe.library_file(catalogue.tokenizer(name)).library.encode(text or "", add_special_tokens=False).ids + [2]


def test_grammar_files(odd, empty, given):
    path = catalogue.tokenizer("word_bpe_49k.json")
    for frame in (odd, given):
        rows = texts_of(frame)
        expected, start = [], 0
        for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            ids = library_ids("word_bpe_49k.json", t)
            expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = sorted((tuple(r) for r in grammar.round_trip(frame, path, 2).collect()), key=lambda r: r[1])
        assert got == expected
    assert grammar.round_trip(empty, path, 2).count() == 0


def test_grammar_random_access():
    rng = np.random.default_rng(4)
    words_ = [rng.integers(0, 50, n) for n in rng.integers(1, 9, 40)]
    which = rng.choice(40, 5000, p=np.arange(1, 41)[::-1] / 820)
    lengths = np.array([len(w) for w in words_])
    made = grammar.compress(np.concatenate(words_), lengths, which, 50, 4)
    flat = np.concatenate([words_[i] for i in which])
    assert len(made.body) < len(which) and (made.decode() == flat).all()
    for a, b in [(0, 1), (17, 400), (len(flat) - 3, len(flat)), (500, 500)]:
        assert made.decode(a, b).tolist() == flat[a:b].tolist()
    # no pair of neighbours is left that is as frequent as a rule must be
    left = defaultdict(int)
    at = 0
    while at + 1 < len(made.body):
        left[made.body[at], made.body[at + 1]] += 1
        at += 1
    assert max(left.values()) < 4


def test_grammar_documents_by_range(spark, odd, tmp_path):
    path = catalogue.tokenizer("word_bpe_49k.json")
    grammar.write(odd, path, 2, f"{tmp_path}/shards")
    known = [(i, t) for i, t in texts_of(odd) if i is not None]
    wanted = sorted({i for i, _ in known})[::2]
    asked = spark.createDataFrame([(i,) for i in [*wanted, wanted[0], 10**12, None]], "doc_id bigint")
    got = sorted((r.doc_id, list(r.ids)) for r in grammar.read_documents(spark, f"{tmp_path}/shards", path, asked).collect())
    assert got == sorted((i, library_ids("word_bpe_49k.json", t)) for i, t in known if i in wanted)
    assert grammar.read_documents(spark, f"{tmp_path}/shards", path, asked.limit(0)).count() == 0


def check_packing(rows, got):
    expected = []
    for i, t in rows:
        ids = library_ids("byte_bpe_50k.json", t)
        head = len(ids) - (-(-len(ids) // 1024) - 1) * 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got))) == sorted(map(str, expected))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), sum(r.length for r in got)


def test_packing(odd, empty, given):
    path = catalogue.tokenizer("byte_bpe_50k.json")
    for frame in (odd, given):
        n, total = check_packing(texts_of(frame), packing.pack(packing.pieces(frame, path, 2)).collect())
        assert n <= 1.03 * -(-total // 1024) + 1
    assert packing.pack(packing.pieces(empty, path, 2)).count() == 0


def test_fullest_combination_is_found():
    rng = np.random.default_rng(2)
    for _ in range(30):
        counts = np.zeros(41, np.int64)
        for length in rng.integers(1, 41, 8):
            counts[length] += rng.integers(1, 4)
        room = int(rng.integers(1, 41))
        used = packing._fullest(counts, room)
        sums = {0}
        for length in np.flatnonzero(counts):
            sums = {s + k * length for s in sums for k in range(counts[length] + 1) if s + k * length <= room}
        assert sum(k * n for k, n in used.items()) == max(sums)
        assert all(n <= counts[k] for k, n in used.items())


# --- op7 -------------------------------------------------------------------


def plain_chain(places):
    """A longest ascending subsequence, by patience piles."""
    piles, link = [], {}
    for i, p in enumerate(places):
        k = next((k for k, (top, _) in enumerate(piles) if top >= p), len(piles))
        link[i] = piles[k - 1][1] if k else None
        piles[k:k + 1] = [(p, i)]
    i, out = piles[-1][1] if piles else None, []
    while i is not None:
        out.append(i)
        i = link[i]
    return out[::-1]


def plain_patience(a, b, i0=0, j0=0):
    """Aligned places of two lists of lines."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    out = [(i0 + k, j0 + k) for k in range(head)]
    a, b, i0, j0 = a[head:], b[head:], i0 + head, j0 + head
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out += [(i0 + len(a) - 1 - k, j0 + len(b) - 1 - k) for k in range(tail)]
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return sorted(out)
    once = [Counter(x) for x in (a, b)]
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if once[0][x] == once[1][x] == 1]
    if anchors:
        anchors = [anchors[k] for k in plain_chain([j for _, j in anchors])]
        edges = [(-1, -1), *anchors, (len(a), len(b))]
        for (i, j), (i2, j2) in zip(edges, edges[1:]):
            out += plain_patience(a[i + 1 : i2], b[j + 1 : j2], i0 + i + 1, j0 + j + 1)
        out += [(i0 + i, j0 + j) for i, j in anchors]
    else:
        kinds = [[(x, y[:k].count(x)) for k, x in enumerate(y)] for y in (a, b)]
        pairs = [(i, kinds[1].index(x)) for i, x in enumerate(kinds[0]) if x in kinds[1]]
        out += [(i0 + pairs[k][0], j0 + pairs[k][1]) for k in plain_chain([j for _, j in pairs])]
    return sorted(out)


def plain_deletions(rows, min_words=10):
    """The lines that stay of each text, with one row for each id: repeated patience diffs of all pairs of documents."""
    lines = {i: [x for x in (t or "").split("\n") if words(x)] for i, t in rows if i is not None}
    held = {i: set(x) for i, x in lines.items()}
    out = {}
    for i, mine in lines.items():
        out[i] = gone = set()
        for o, theirs in lines.items():
            if o >= i or held[o].isdisjoint(held[i]):
                continue
            left = list(range(len(mine)))
            while True:
                run, new = [], []
                for pair in [*((left[x], y) for x, y in plain_patience([mine[x] for x in left], theirs)), None]:
                    if run and (pair is None or pair != (run[-1][0] + 1, run[-1][1] + 1)):
                        if sum(len(words(mine[x])) for x, _ in run) >= min_words:
                            new.append((run[0][0], run[-1][0]))
                        run = []
                    run.append(pair)
                if not new:
                    break
                gone.update(new)
                left = [x for x in left if not any(a <= x <= b for a, b in new)]
    result = {}
    for i, text in rows:
        kept, nth = [], -1
        for line in (text or "").split("\n"):
            worded = bool(words(line))
            nth += worded
            if not any(a <= nth <= b if worded else a <= nth < b for a, b in out.get(i, ())):
                kept.append(line)
        result[i] = None if text is None else "\n".join(kept)
    return result


def test_line_alignment(odd, empty, given):
    got = linealign.without_blocks(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_deleted", "words_deleted"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == TEXTS[0][1] and rows[2].text == "" and rows[2].words_deleted == 27
    assert rows[3].text == "\nanother ending that is not like the first one at all"
    assert rows[4].text is None and rows[5].text == "" and rows[7].text == "one two" and rows[None].n_deleted == 0
    assert linealign.without_blocks(empty).count() == 0
    found = {r.doc_id: r.text for r in linealign.without_blocks(given).collect()}
    assert found == plain_deletions(texts_of(given))


def test_alignment_of_moved_and_repeated_lines(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(6)) for x in "abcd")
    rows = [(1, "\n".join([a, b, c, c, d])), (2, "\n".join([c, d, a, b, "mine", c, c])), (3, "\n".join([b, a, "y", c, c, d]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linealign.without_blocks(frame).collect()}
    assert got == plain_deletions(rows)
    assert got[3].split("\n")[-1] == "y"


def test_alignment_with_documents_that_are_not_the_first_holders(spark):
    """A passage is found as one block although another document holds its middle line, or its owner holds a line twice."""
    p, x, q = ("p1 p2 p3 p4 p5", "x1 x2 x3 x4 x5", "q1 q2 q3 q4 q5")
    a, b, c = ("a1 a2 a3 a4 a5 a6", "b1 b2 b3 b4 b5 b6", "c1 c2 c3 c4 c5 c6")
    texts = [(1, f"own\n{b}\nline"), (2, f"two\n{a}\n{b}\n{c}"), (3, f"{a}\n\n{b}\n{c}\nthree"), (4, f"{x}\nfour\n{p}\n{x}\n{q}"), (5, f"five\n{p}\n{x}\n{q}\nsix")]
    frame = spark.createDataFrame([(*t, 7, "n", 8) for t in texts], "doc_id bigint, text string, n_lines int, n_deleted string, words_deleted int")
    rows = {r.doc_id: r for r in linealign.without_blocks(frame).collect()}
    assert {i: r.words_deleted for i, r in rows.items()} == {1: 0, 2: 0, 3: 18, 4: 0, 5: 15}
    assert rows[3].text == "three" and rows[5].text == "five\nsix" and rows[5].n_deleted == 3
    assert {i: r.text for i, r in rows.items()} == plain_deletions(texts)


def test_alignment_of_random_documents(spark):
    """Documents made of shared runs of lines, whole and shuffled, against the diff of all pairs: it finds nothing that is not found here."""
    rng = np.random.default_rng(11)
    passages = [[" ".join(f"v{x}" for x in rng.integers(0, 40, int(rng.integers(1, 9)))) for _ in range(int(rng.integers(1, 7)))] for _ in range(12)]
    texts = []
    for i in range(40):
        lines = []
        for k in rng.integers(0, 12, int(rng.integers(1, 6))):
            lines += [*passages[k], *([""] if rng.random() < 0.3 else []), f"own line {i} {k} " + "w " * int(rng.integers(0, 8))]
        texts.append((i, "\n".join(lines)))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.text for r in linealign.without_blocks(frame).collect()}
    want = plain_deletions(texts)
    # lines in no common run may stand in the way of the plain diff
    assert all(len(got[i]) <= len(want[i]) for i, _ in texts)
    assert sum(got[i] == want[i] for i, _ in texts) >= 38
    first, lines = {}, [[x for x in t.split("\n") if words(x)] for _, t in texts]

    def spans(mine):
        return [(a, b) for a in range(len(mine)) for b in range(a + 1, len(mine) + 1) if sum(len(words(x)) for x in mine[a:b]) >= 10]

    for i, mine in enumerate(lines):
        for a, b in spans(mine):
            first.setdefault(tuple(mine[a:b]), i)
    for i, mine in enumerate(lines):
        # no run of an earlier document is left, and no line goes that is in none
        gone = {x for a, b in spans(mine) if first[tuple(mine[a:b])] < i for x in range(a, b)}
        assert [x for x in got[i].split("\n") if words(x)] == [x for k, x in enumerate(mine) if k not in gone]


@pytest.mark.parametrize("seed", range(5))
def test_longest_chain(seed):
    places = np.random.default_rng(seed).permutation(12)
    chain = linealign.longest_chain(places)
    best = [1] * 12
    for i in range(12):
        best[i] = 1 + max([best[j] for j in range(i) if places[j] < places[i]], default=0)
    assert len(chain) == max(best) and (np.diff(places[chain]) > 0).all()


# --- op8 -------------------------------------------------------------------


def test_languages(given):
    rows = langid.predictions(given, catalogue.remainder(3) == 1).join(given.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert len(rows) == given.count() and test
    assert np.mean([r.lang == r.lang_pred for r in test]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(odd, empty, given):
    learned = given.select("doc_id", "text", "lang")
    both = learned.unionByName(odd.where("doc_id <> 8").select(F.col("doc_id") + 100_000, "text", F.lit(None).cast("string")).toDF("doc_id", "text", "lang"))
    rows = {r.doc_id: r for r in langid.predictions(both, F.col("doc_id") >= 100_000).where("held_out").collect()}
    assert rows[100_004].lang_pred == rows[100_005].lang_pred == rows[100_011].lang_pred == "und"
    assert rows[100_004].score == 0 and rows[100_001].lang_pred == "en"
    nothing = langid.predictions(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.predictions(empty, F.lit(False)).count() == 0


# --- op10 ------------------------------------------------------------------


def plain_quality(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    repeated = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), failed


@pytest.mark.parametrize("table", ["odd", "given"])
def test_quality_counts(request, table):
    frame = request.getfixturevalue(table)
    rows = quality.verdicts(frame).collect()
    got = [str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows]
    assert sorted(got) == sorted(str((i, *plain_quality(t))) for i, t in texts_of(frame))
    assert not any(r.kept and r.base_failed for r in rows)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in rows)


def test_quality_verdicts(spark, empty):
    rng = np.random.default_rng(6)
    plain = ["the", "of", "and", "a", "to"] + [f"{x}{y}ing" for x in "bcdfg" for y in "aeiou"]
    rows = [(i, " ".join(rng.choice(plain, 150)) + ".", "en") for i in range(60)]
    rows += [(100, " ".join(w + "***&&&" for w in rng.choice(plain, 150)), "en"), (101, " ".join(f"zq{i}x" for i in range(150)), "en")]
    kept = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(kept[i] for i in range(60)) and not kept[100] and not kept[101]
    assert quality.verdicts(empty).count() == 0


def test_distance_of_equal_and_disjoint_histograms():
    p = np.array([[0.5, 0.5, 0, 0]])
    assert quality.distance(p, p)[0, 0] == 0
    assert quality.distance(p, p[:, ::-1])[0, 0] == pytest.approx(1)
