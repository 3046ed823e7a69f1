import functools
import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import alignment as L

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: The same step as byte-level vocabularies define it, written out from the file itself.
LETTERS = {c: b for b, c in enumerate(
    [chr(256 + b) for b in range(33)] + [chr(b) for b in range(33, 127)] + [chr(256 + 33 + b) for b in range(34)]
    + [chr(b) for b in range(161, 173)] + [chr(256 + 67)] + [chr(b) for b in range(174, 256)])}


@functools.cache
def both():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    with open(A_FILE, encoding="utf-8") as f:
        words = {i: w for w, i in json.load(f)["model"]["vocab"].items()}
    return a, words, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def plain(text):
    """Groups of (A ids, B ids), token by token with the files' own tokenizers."""
    a, words, b = both()
    if not text:
        return []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in words[i]) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b))]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    groups, i, j, end_a, end_b, now = [], 0, 0, 0, 0, ([], [])
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            end_a += len(bytes_a[i])
            now[0].append(ids_a[i])
            i += 1
        else:
            end_b += len(bytes_b[j])
            now[1].append(ids_b[j])
            j += 1
        if end_a == end_b:
            groups.append(now)
            now = ([], [])
    return groups


def expected(rows):
    every = [(i, plain(t)) for i, t in rows]
    count = Counter()
    for _, groups in every:
        count.update({(a, b) for g in groups for a in g[0] for b in g[1]})
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for i, groups in every:
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(count[x] == highest[x[0]] for x in links), sum(count[x] for x in links), said))
    return sorted(out, key=str)


def digests(rows):
    return sorted(((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in rows), key=str)


TEXTS = ["", None, "a", " lead", "two  spaces   and\ttabs\n\n", "<|endoftext|> and <s>x</s>", "▁ marked", "x\x00y", "naïve 中文 \U0001f600 é",
         "123456789 " * 50, "ab" * 3000, "　wide ", "don't we'll I'm", "\r\n" * 20, "<0x41>", "é" * 5000, "the the the", "the"]


@pytest.mark.parametrize("part", [L.PART, 7])
def test_equals_token_by_token(spark, part):
    rnd = random.Random(2)
    alphabet = ["a", "B", " ", "  ", "\n", "'s", "1", "é", "中", "\U0001f600", "token", "izer", "-", "<0x0A>", "▁" if part == 7 else "x"]
    rows = [*enumerate(TEXTS), *((i % 20, "".join(rnd.choices(alphabet, k=rnd.randint(0, 60)))) for i in range(100, 250)), (None, "a"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, row long, groups string")
    got = L.align(docs, A_FILE, B_FILE, part_pairs=part).collect()
    want = expected(rows)
    assert sorted(map(tuple, got), key=str) == want
    if part == 7:
        assert sorted(map(tuple, L.align(docs, A_FILE, B_FILE, digest=True).collect()), key=str) == digests(want)


def test_query_equals_token_by_token(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = L.op12_align_dictionaries(spark, SF_SMALL).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got), key=str) == digests(expected(rows))


def test_common_ends_by_window():
    rnd = np.random.default_rng(1)
    for window in (1, 7, 1000, 1 << 18):
        a, b = np.cumsum(rnd.integers(1, 9, 500)), np.cumsum(rnd.integers(1, 9, 400))
        i, j = L.common_ends(a, b, window)
        assert (a[i - 1] == np.intersect1d(a, b)).all() and (b[j - 1] == np.intersect1d(a, b)).all()
    assert len(L.common_ends(np.zeros(0, np.int64), a)[0]) == 0


@pytest.mark.parametrize("expand", [1, 5, 100, 1 << 20])
def test_links_whatever_the_expansion(expand):
    rnd = np.random.default_rng(3)
    na, nb = rnd.integers(1, 6, 80), rnd.integers(1, 6, 80)
    at_a, at_b = (np.concatenate([[0], np.cumsum(x)]) for x in (na, nb))
    a, b, text = rnd.integers(0, 4, at_a[-1]), rnd.integers(0, 3, at_b[-1]), np.sort(rnd.integers(0, 5, 80))
    keys, times = L.link_pairs(text, at_a, at_b, a, b, 3, expand)
    want = Counter(int(text[g]) << 32 | int(x) * 3 + int(y) for g in range(80) for x in a[at_a[g]:at_a[g + 1]] for y in b[at_b[g]:at_b[g + 1]])
    assert dict(zip(keys.tolist(), times.tolist())) == want and (np.diff(keys) > 0).all()


def test_long_white_space_takes_the_exact_tokenizer():
    with open(A_FILE, encoding="utf-8") as f, open(B_FILE, "rb") as g:
        t = L.Tokenizers(f.read(), g.read())
    for text in (" " * 1_200_000 + "x", "a\n" + "\n" * 60_000):
        assert t.a_ids(text) == both()[0].encode(text, add_special_tokens=False).ids


def test_odd_rows_and_no_rows(spark):
    docs = odd_documents(spark)
    got = L.align(docs, A_FILE, B_FILE).collect()
    assert sorted(map(tuple, got), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert L.align(no_documents(spark), A_FILE, B_FILE).count() == 0


@pytest.mark.parametrize("most", [0, 5, L.CACHE])
def test_texts_cut_into_kept_segments_equal_whole_ones(monkeypatch, most):
    monkeypatch.setattr(L, "CACHE", most)
    monkeypatch.setattr(L, "KEPT_LENGTH", 9)
    with open(A_FILE, encoding="utf-8") as f, open(B_FILE, "rb") as g:
        t = L.Tokenizers(f.read(), g.read())
    assert t.cuts
    rnd = random.Random(4)
    marks = ["a", "word", "Longer-segment", " ", "  ", "   ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", ".", "'s", "1", "é", "中", "\U0001f600", "▁" if most == 5 else "b"]
    texts = ["".join(rnd.choices(marks, k=rnd.randint(0, 12))) for _ in range(3000)] + TEXTS + ["a ", "a  ", " ", "  ", "a b ", "\n a", "a\n  b"]
    for at in range(0, len(texts), 700):
        some = texts[at:at + 700]
        got = [c.to_pylist() for c in L.aligned_columns(some, t)]
        for i, x in enumerate(some):
            groups = plain(x)
            links = Counter(a * 32000 + b for g in groups for a in g[0] for b in g[1])
            assert got[4][i] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode(), x
            assert (got[0][i], got[1][i], got[2][i], got[3][i]) == (sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()))
            assert dict(zip(got[5][i], got[6][i])) == links
