import hashlib

from tests.conftest import SF_SMALL
from tests.llm.fixtures import no_documents, odd_documents
from tunesift.llm import fingerprint as Q


def brute(rows):
    """rows in descending order -> [(id, n, sha, fp, edited fp, near edited, near next)]."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 2
        e = (t[:len(t) - cut] + nxt[:cut]).encode()
        d = [Q.digest(x) for x in (t.encode(), e, nxt.encode())]
        out.append((i, len(t), hashlib.sha256(e).hexdigest(), d[0].hex(), d[1].hex(), Q.likeness(d[0], d[1]), Q.likeness(d[0], d[2])))
    return out


def brute_digest(raw):
    counts = [0] * 256
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> 24] += 1
    q = sorted(counts)
    codes = [sum(n > q[i] for i in (63, 127, 191)) for n in counts]
    return codes


def test_digest_equals_its_definition_and_crosses_strides(monkeypatch):
    text = ("Straße und naïve words, repeated a little " * 40).encode()
    want = Q.digest(text)
    assert list(Q.codes(want)) == brute_digest(text)
    monkeypatch.setattr(Q, "STRIDE", 7)
    assert Q.digest(text) == want


def test_likeness_is_bounded():
    a, b = Q.digest(b"abc def ghi " * 30), Q.digest(bytes(range(256)) * 9)
    assert Q.likeness(a, a) == 1.0 and 0.0 <= Q.likeness(a, b) < 0.6 and Q.likeness(a, b) == Q.likeness(b, a)


def test_query_equals_brute_force(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()), reverse=True)
    got = sorted((tuple(r) for r in Q.op3_fingerprint_quartile(spark, SF_SMALL).collect()), reverse=True)
    want = brute(rows)
    assert got == want
    assert sum(w[5] > w[6] for w in want) > 0.95 * len(want)  # half-kept texts are nearer than other ones


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = Q.edited_likeness(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[3].n_chars == by[4].n_chars == 0 and by[3].fingerprint == by[4].fingerprint
    assert by[1].fingerprint == by[2].fingerprint and by[9].n_chars == 150_000
    long_text = "wort " * 30_000
    assert by[9].edited_sha256 == hashlib.sha256((long_text[:75_000] + "12345 !!! ---").encode()).hexdigest()
    # the row without an id is last; after it comes the first (greatest id)
    last = "a row without an id is still a row of words"
    assert by[None].edited_sha256 == hashlib.sha256((last[:len(last) - len(last) // 2] + "repeated row of words"[:len(last) // 2]).encode()).hexdigest()
    assert Q.edited_likeness(no_documents(spark)).count() == 0
    one = Q.edited_likeness(docs.filter("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert Q.fingerprints(docs).count() == docs.count()


def test_a_third_of_the_rows_share_an_id_or_lack_one(spark):
    """Rows of one id follow by their text's hash and are many spans; their neighbours stay the same."""
    import xxhash  # Spark hashes a text's bytes with the same seed
    rows = [(7, f"hot text {i} " * 3) for i in range(150)] + [(None, f"without id {i}") for i in range(150)] + [(i, f"own {i}") for i in range(100, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, spans = Q.with_next(docs, "doc_id", "text")
    sizes = [r[1] for r in Q.with_next(docs, "doc_id", "text")[0].groupBy("span").count().collect()]
    assert spans > 8 and max(sizes) < 90
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    got = sorted((tuple(r) for r in Q.edited_likeness(docs).collect()), key=str)
    assert got == sorted(brute(order), key=str)
    assert Q.edited_likeness(spark.createDataFrame([(None, "same")] * 9 + [(4, "same")] * 9, "doc_id long, text string").repartition(4)).count() == 18
