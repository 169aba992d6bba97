"""Cross-tokenizer alignment against the libraries and plain loops."""

import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from exprstudy.llm import bpe, tokenalign
from exprstudy.llm.catalogue import tokenizer

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths():
    return tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def plain_tokens(text, paths):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "files"):
        file_a, file_b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
        file_a.encode_special_tokens = True
        plain_tokens.files = file_a, file_b
    file_a, file_b = plain_tokens.files
    if not text:
        return [], []
    byte_of = {c: i for i, c in enumerate(bpe._byte_characters())}
    a = [(i, bytes(byte_of[c] for c in file_a.id_to_token(i))) for i in file_a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in file_b.encode(text):
        piece = file_b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if file_b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def plain_reports(rows, paths):
    def spans(tokens):
        at = 0
        for i, x in tokens:
            yield i, at, at + len(x)
            at += len(x)

    docs, counts = [], Counter()
    for doc, text in rows:
        a, b = (list(spans(t)) for t in plain_tokens(text, paths))
        links, first = [], 0
        for i, start, end in a:
            while first < len(b) and b[first][2] <= start:
                first += 1
            k = first
            while k < len(b) and b[k][1] < end:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, i, j = [], 0, 0
        for c in cuts:
            left, right = [], []
            while i < len(a) and a[i][2] <= c:
                left.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= c:
                right.append(str(b[j][0]))
                j += 1
            parts.append(",".join(left) + "|" + ",".join(right))
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else ""
        docs.append((doc, len(a), len(b), len(cuts), links, digest))
        counts.update(links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        ((d, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, na, nb, g, ls, h in docs),
        key=str,
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "Hello world, it's <|endoftext|> and <s>."),
    (4, "Hello world, it's <|endoftext|> and <s>."),
    (5, "naïve café — 日本語 ▁ mark"),
    (6, "naïve café — 日本語 🙂🙂 mark\n\n\ttabs  and   spaces \r\n"),
    (7, "x" * 30_000),
    (None, "no id but words"),
    (8, "word " * 30_000),
    (9, "\x00\x01 control"),
    (10, "12345 ### $$$ …"),
]


def compare(frame, paths):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in tokenalign.reports(frame, *paths).collect()), key=str)
    want = plain_reports(rows, paths)
    assert got == want
    return want


def test_odd_rows(spark, paths):
    frame = spark.createDataFrame([(*r, 1, "p", 2) for r in ODD], "doc_id bigint, text string, block int, pairs string, n_a int").repartition(3)
    want = compare(frame, paths)
    assert sum(w[1] == 0 for w in want) == 3
    assert tokenalign.reports(frame.where("doc_id > 1000"), *paths).count() == 0


def test_lanes_and_slices_change_nothing(paths):
    """Random token ends; the number of lanes has no influence, and links are those of a plain merge."""
    rng = np.random.default_rng(1)
    at, ends, texts = [[0], [0]], [[], []], 0
    plain = []
    for _ in range(30):
        size = int(rng.integers(0, 200))
        mine = []
        for side in (0, 1):
            own = np.unique(np.append(rng.integers(1, size + 1, size // 3), size)) if size else np.zeros(0, int)
            mine.append(own)
            ends[side].extend((own + texts).tolist())
            at[side].append(len(ends[side]))
        a0, b0 = at[0][-2], at[1][-2]
        for i, e in enumerate(mine[0]):
            s = mine[0][i - 1] if i else 0
            for j, f in enumerate(mine[1]):
                t = mine[1][j - 1] if j else 0
                if s < f and t < e:
                    plain.append((a0 + i, b0 + j))
        texts += size
    tokens = [tokenalign.Tokens(np.arange(len(e)), np.array(p), np.array(e)) for p, e in zip(at, ends)]
    for lane in (1, 2, 7, 1000):
        found = tokenalign.lockstep(*tokens, lane)
        assert list(zip(found.link_a.tolist(), found.link_b.tolist())) == plain
        assert set(tokens[0].end[found.cut_a]) == set(ends[0]) & set(ends[1]) == set(tokens[1].end[found.cut_b])


def test_alignments_are_spans(spark, paths):
    frame = spark.createDataFrame([r for r in ODD if r[0] not in (7, 8)], "doc_id bigint, text string")
    for r in tokenalign.alignments(frame, *paths).collect():
        if not r.a_ids:
            continue
        assert len(r.link_a) == len(r.link_b) == len(r.a_ids) + len(r.b_ids) - len(r.cuts)
        text = next(t for i, t in ODD if i == r.doc_id)
        assert r.cuts == sorted(r.cuts) and r.cuts[-1] == len((" " + text).encode())
        assert (r.link_a[0], r.link_b[0]) == (0, 0) and (r.link_a[-1], r.link_b[-1]) == (len(r.a_ids) - 1, len(r.b_ids) - 1)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
def test_given_documents(spark, paths):
    want = compare(spark.read.parquet(f"{FOLDER}/documents.parquet"), paths)
    assert sum(w[1] > 0 for w in want) > 150
