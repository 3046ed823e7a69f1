import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import packing as K

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """The least number of sequences, by exhaustive search."""
    sizes = tuple(sorted(sizes, reverse=True))

    @lru_cache(None)
    def go(rest):
        if not rest:
            return 0
        best = len(rest)
        first, others = rest[0], rest[1:]
        for mask in range(1 << len(others)):
            pick = [others[i] for i in range(len(others)) if mask >> i & 1]
            if first + sum(pick) <= capacity:
                best = min(best, 1 + go(tuple(others[i] for i in range(len(others)) if not mask >> i & 1)))
        return best
    return go(sizes)


def test_packings_are_whole_and_as_few_as_an_exhaustive_search_finds():
    rnd = random.Random(3)
    for _ in range(60):
        capacity = rnd.choice([10, 20, 50])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))]
        hist = {s: sizes.count(s) for s in set(sizes)}
        patterns = K.packing(hist, capacity)
        used = {}
        for times, lengths in patterns:
            assert sum(lengths) <= capacity
            for s in lengths:
                used[s] = used.get(s, 0) + times
        assert used == hist
        assert sum(t for t, _ in patterns) == fewest(sizes, capacity)


def test_many_pieces_meet_the_lower_bound():
    rnd = random.Random(5)
    hist = {}
    for _ in range(50_000):
        s = min(4096, int(rnd.lognormvariate(6, 1)) + 1)
        hist[s] = hist.get(s, 0) + 1
    counts = np.zeros(4098, np.int64)
    for s, n in hist.items():
        counts[s] = n
    assert sum(t for t, _ in K.packing(hist)) <= K.lower_bound(counts, 4096) + 1


@pytest.mark.parametrize("hist", [{1: 50_000, 3: 20_000, 500: 100}, {10: 30_000}, {2: 3000, 7: 1, 4000: 3}, {4096: 5, 1: 1}])
def test_short_pieces_fill_sequences_whatever_the_effort(hist, monkeypatch):
    counts = np.zeros(4098, np.int64)
    for s, n in hist.items():
        counts[s] = n
    least = K.lower_bound(counts, 4096)
    assert sum(t for t, _ in K._pack(counts.copy(), 4096, 0, 0, None)) <= least + 1  # best-fit, without search
    monkeypatch.setattr(K, "FILL_EFFORT", 1)
    patterns, used = K.packing(hist), {}
    for times, lengths in patterns:
        assert sum(lengths) <= 4096
        for s in lengths:
            used[s] = used.get(s, 0) + times
    assert used == hist and sum(t for t, _ in patterns) <= least + 1


def test_a_filling_of_smaller_pieces_may_beat_the_largest_that_fits():
    counts = np.bincount([7, 5, 5], minlength=12)
    assert K.fill(counts, 10, 0) == [7] and K.fill(counts, 10, 100) == [5, 5]


def check(rows, ids_of, capacity=4096):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for i, own in by_doc.items():
        ids = np.array([*ids_of[i], 1], "<u4")
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = ids[k * capacity:(k + 1) * capacity]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, k * capacity, len(part), zlib.crc32(part.tobytes()))
        assert len(own) == -(-len(ids) // capacity)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def encode(text):
    from tokenizers import Tokenizer
    global _T
    _T = globals().get("_T") or Tokenizer.from_file(FILE)
    return _T.encode(text or "", add_special_tokens=False).ids


def test_query_equals_the_tokenizer_and_packs_tightly(spark):
    docs = {r.doc_id: encode(r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    used = check(K.op6_pack_bin_completion(spark, SF_SMALL).collect(), docs)
    assert used <= -(-sum(len(x) + 1 for x in docs.values()) // 4096) + 1


def test_odd_rows_and_whole_sequences(spark):
    docs = odd_documents(spark).filter("doc_id is null or doc_id != 11")
    pieces = K.tokenised_pieces(docs, FILE, with_ids=True)
    packed = K.pack(pieces)
    rows = packed.collect()
    check(rows, {r.doc_id: encode(r.text) for r in docs.collect()})
    whole = {r.sequence_id: r for r in K.sequences(packed).collect()}
    for s, r in whole.items():
        want = [x for p in sorted((p for p in rows if p.sequence_id == s), key=lambda p: p.offset) for x in p.ids]
        assert r.ids == want
    assert K.pack(K.tokenised_pieces(no_documents(spark), FILE)).count() == 0
    twice = odd_documents(spark).filter("doc_id = 11")
    assert K.pack(K.tokenised_pieces(twice, FILE)).count() == 2


@pytest.mark.parametrize("text", ["", "a.b", "Don't STOP.", "wait...?!", "«mot», naïve;", "é́.", "x y,z", "<|endoftext|>, <|EndOfText|>.",
                                  "123.45 7,", "Σίσυφος. ΟΔΟΣ", "Á! ́. ﬁn,", "tab\tand\x0bline\n.", "!! 's 've."])
def test_words_in_a_row_are_the_text(text):
    import pyarrow as pa
    ids, ends = K.WordTokens(open(FILE).read()).texts(pa.array([text, None, text]))
    assert ids[ends[0]:ends[1]].tolist() == ids[ends[2]:ends[3]].tolist() == encode(text)
