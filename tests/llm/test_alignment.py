"""Operator 11 against a plain merge of the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from casewell.llm import op11_token_alignment as op11

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a  b", " a", "a ", "\n", "\nx", "x\n", "▁x", "</s> <s> <unk> <|endoftext|>", "foo\n \nbar", "foo\n bar", "foo \nbar", "one\ntwo\n\nthree", "a b", "x　 y",
    "x\u0085 \u0085y", "😀 ünï  z", "it's  we'll don't", "a\r\n b\t c", "\x00 q", "é ́e", "﻿ b", "12 345 67.8", "word " * 3000 + "end", "x" * 20000,
]


@pytest.fixture(scope="module")
def aligner():
    return op11.aligner(A, B)


def plain(al, text):
    """Tokens of A and B, groups and links of a text by walking both lists of ends."""
    a, b = al.a.encode(" " + (text or ""), add_special_tokens=False).ids, al.b.encode(text or "")
    x, y = [al.a_bytes[i] for i in a], [al.b_bytes[i] for i in b]
    if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
        return 0, 0, "", []
    ends = {e: k for k, e in enumerate(np.cumsum([len(t) for t in y]).tolist())}
    groups, links, p, q = [], [], 0, 0
    for k, e in enumerate(np.cumsum([len(t) for t in x]).tolist()):
        if e in ends:
            groups.append(",".join(map(str, a[p : k + 1])) + "|" + ",".join(map(str, b[q : ends[e] + 1])))
            links.append((a[k], b[ends[e]]))
            p, q = k + 1, ends[e] + 1
    return len(a), len(b), ";".join(groups), links


@pytest.mark.parametrize("piece", [1, 2, 3, 64, 4096])
def test_merge_pieces_give_all_common_ends_and_equal_work(piece):
    draw = np.random.default_rng(piece)
    for n, m in [(0, 0), (0, 9), (9, 0), (1, 1), (500, 3), (700, 650)]:
        a, b = (np.unique(draw.integers(0, 1500, k)) for k in (n, m))
        i, j = op11.common_ends(a, b, piece)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a) & set(b))
        x, y = op11.crossings(a, b, piece)
        assert x[-1] == len(a) and y[-1] == len(b) and ((np.diff(x) + np.diff(y))[:-1] == piece).all()


def test_texts_of_any_kind_equal_the_plain_merge(aligner):
    random.seed(7)
    letters = list("ab 1.'s\n\t é😀▁ 　​")
    texts = [t or "" for t in ODD] + ["".join(random.choice(letters) for _ in range(random.randint(1, 14))) for _ in range(3000)]
    for t, got in zip(texts, aligner.align(texts)):
        want = plain(aligner, t)
        assert got[:3] == want[:3] and got[3].tolist() == [x << 32 | y for x, y in want[3]], repr(t[:50])


def expected(al, rows):
    found = [(i, *plain(al, t)) for i, t in rows]
    count = Counter(p for f in found for p in f[4])
    top = Counter()
    for (a, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(
        (str(i), na, nb, len(ls), len(ls), sum(count[p] == top[p[1]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, na, nb, g, ls in found
    )


@pytest.mark.parametrize("most", [op11.MOST_PAIRS, 0])
def test_counts_equal_brute_force_by_broadcast_and_by_join(spark, sf, aligner, most):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a  b"), (None, "same text"), (None, "same text"), (-4, "Same text")]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text").collect()]
    docs = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, n_a int, pairs string, b int")
    got = op11.with_counts(op11.saved(op11.align(docs, A, B), "t"), most)
    have = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect())
    assert have == expected(aligner, rows)


def test_groups_are_an_output_and_empty_tables_give_nothing(spark, aligner):
    docs = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    row = op11.align(docs, A, B, with_groups=True).first()
    assert row.groups == plain(aligner, "two words")[2] and row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest()
    assert op11.with_counts(op11.saved(op11.align(docs.where("false"), A, B), "t")).count() == 0


def test_query_runs_over_all_documents(spark, sf):
    import __spark_entry__

    got = __spark_entry__.queries()["op11_token_alignment"](spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
