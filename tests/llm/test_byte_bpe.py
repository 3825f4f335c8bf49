import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from brute import DOCS, docs_frame, rows_of
from hypothesis import given, settings, strategies as st

from codexlake.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = byte_bpe.ByteBPE(PATH, PATTERN)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab cdeZé.,'s\n\t\x1c\x85\xa0　1½ǅß日🙂", max_size=60) | st.text(max_size=40), max_size=8))
def test_ids_of_the_plain_coder(texts):
    got = BPE.encode(texts)
    assert [g.tolist() for g in got] == [PLAIN.encode_ordinary(t) for t in texts]
    assert [BPE.decode(g) for g in got] == [t.encode() for t in texts]


def test_ranks_that_fall_while_merging(tmp_path):
    """Merged pairs whose joint token has a lower rank than the parts: the order of merges must still be leftmost least."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {t: 300 - i for i, t in enumerate([b"ab", b"aba", b"ba", b"bab", b"aa", b"abab", b"bb"])}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = byte_bpe.ByteBPE(str(path), r"[ab]+")
    plain = tiktoken.Encoding("own", pat_str=r"[ab]+", mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(3)
    for n in (*range(1, 40), 1100, 3000):
        text = "".join(draw.choice("ab") for _ in range(n))
        assert own.encode([text])[0].tolist() == plain.encode_ordinary(text), text[:40]


def test_long_pieces():
    draw = random.Random(5)
    texts = ["a" * n for n in (1023, 1024, 1025, 30_000)] + ["".join(draw.choice("abcdeé") for _ in range(40_000)), " " * 9000 + "x", "é" * 5000, "word " * 50_000]
    assert [g.tolist() for g in BPE.encode(texts)] == [PLAIN.encode_ordinary(t) for t in texts]


def test_pair_lookup_against_a_dictionary():
    draw = random.Random(7)
    left, right = (byte_bpe.np.array([draw.randrange(-1, 600) for _ in range(200_000)], dtype="int32") for _ in "ab")
    got = BPE.pairs(left, right).tolist()
    want = [RANKS.get(BPE.tokens[a] + BPE.tokens[b], byte_bpe.NONE) if a >= 0 and b >= 0 else byte_bpe.NONE for a, b in zip(left.tolist(), right.tolist())]
    assert got == want


def test_table(spark):
    rows = [*DOCS, (20, "".join(map(chr, range(32, 0x3000))), "en", "a"), (21, "x" * 200_000, "en", "a")]
    decoded = byte_bpe.decode(byte_bpe.encode(docs_frame(spark, rows), PATH, PATTERN), PATH, PATTERN)
    got = rows_of(byte_bpe.digests(decoded), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = [(d, PLAIN.encode_ordinary(t or ""), t or "") for d, t, *_ in rows]
    assert got == sorted([(d, len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for d, x, t in ids], key=repr)


def test_store_is_emptied(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_PIECES", 3)
    own = byte_bpe.ByteBPE(PATH, PATTERN)
    for text in ("some first words here", "other second words there", "some first words here"):
        assert own.encode([text])[0].tolist() == PLAIN.encode_ordinary(text)


def test_empty_and_null_ids(spark):
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs_frame(spark, []), PATH, PATTERN), PATH, PATTERN)).collect() == []
    got = byte_bpe.decode(spark.createDataFrame([(1, None), (2, []), (None, [64])], "k long, v array<int>"), PATH, PATTERN, "k", "v").collect()
    assert sorted((r.k or 0, r.decoded if r.decoded is None else bytes(r.decoded)) for r in got) == [(0, BPE.tokens[64]), (1, None), (2, b"")]
