from collections import Counter

import public_tokenizers
import pytest
from brute import DOCS, crc, docs_frame, rows_of
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import numpy as np

from codexlake.llm import packing, token_files
from codexlake.llm.tokens import encoder

PATHS = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
WHOLE = {n: Tokenizer.from_file(p) for n, p in PATHS.items()}
ALPHABET = "ab Zé.,'s\n\t\r\x1c\x85\xa0　 1½ǅßΣ$-_<|>́ İ日"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40) | st.text(max_size=30))
def test_units_give_the_ids_of_the_whole_text(text):
    for name, whole in WHOLE.items():
        assert encoder(PATHS[name]).encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoded(rows, name, end):
    return [(d, WHOLE[name].encode(t or "", add_special_tokens=False).ids + [end]) for d, t, *_ in rows]


def test_files_read_back(spark):
    rows = [r for r in DOCS if r[0] != 11]  # the order of equal ids is not defined by the ids
    start, want = 0, []
    for d, ids in sorted(encoded(rows, "byte_bpe_50k.json", 2), key=lambda x: (x[0] is not None, x[0])):
        if d is not None:
            want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    got = rows_of(token_files.round_trip(docs_frame(spark, rows).repartition(5), PATHS["byte_bpe_50k.json"]), "doc_id", "start", "n_tokens", "ids_crc32")
    assert [r for r in got if r[0] is not None] == sorted(want, key=repr)
    assert len(got) == len(rows)


def test_empty(spark):
    assert token_files.round_trip(docs_frame(spark, []), PATHS["byte_bpe_50k.json"]).collect() == []
    assert packing.pack_documents(docs_frame(spark, []), PATHS["word_bpe_49k.json"]).collect() == []


def test_file_slices(spark, tmp_path):
    docs = docs_frame(spark)
    manifest = token_files.write_token_files(docs, str(tmp_path), PATHS["byte_bpe_50k.json"]).collect()
    assert token_files.read_manifest(spark, str(tmp_path)).collect() == manifest
    with pytest.raises(ValueError):
        token_files.write_token_files(docs, str(tmp_path), PATHS["byte_bpe_50k.json"], dtype="<u1")
    n = 0
    for r in manifest:
        part = token_files.TokenFile(str(tmp_path), r.file)
        assert all(part[i][-1] == 2 for i in range(r.n_docs))
        n += r.n_docs
    assert n == len(DOCS)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 4096)
    rows = DOCS + [(100 + i, "many words in here " * (i * 7 % 300), "en", "a") for i in range(200)]
    pieces = packing.pack_documents(docs_frame(spark, rows).repartition(3), PATHS["word_bpe_49k.json"], with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert p.ids_crc32 == crc(p.ids) and len(p.ids) == p.length > 0
        by_sequence.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    short = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= own[0].context and len({p.context for p in own}) == 1
        short += n < own[0].context
    assert short <= 3
    for d, ids in encoded(rows, "word_bpe_49k.json", 1):
        if d not in (11, None):
            own = sorted(by_doc[d], key=lambda p: p.start)
            assert sum((p.ids for p in own), []) == ids and {p.doc_tokens for p in own} == {len(ids)}
    steps = {}
    for own in by_sequence.values():
        steps.setdefault(own[0].context, Counter())[own[0].step_group] += own[0].context
    assert len({g for x in steps.values() for g in x}) == sum(map(len, steps.values())) and sum(map(len, steps.values())) > 8
    for groups in steps.values():
        *full, last = [groups[g] for g in sorted(groups)]
        assert set(full) <= {4096} and 0 < last <= 4096


def test_padding_is_small(spark):
    """At most one window of each partition is padded, whatever the lengths; a plain next-fit packer pads far more."""
    rows = [(i, "word " * (1 + i * i % 1_500), "en", "a") for i in range(1_000)]
    pieces = packing.pack_documents(docs_frame(spark, rows).repartition(2), PATHS["word_bpe_49k.json"]).collect()
    held = Counter()
    for p in pieces:
        held[p.sequence_id] += p.length
    padded = [p for p in {(p.sequence_id, p.context) for p in pieces} if held[p[0]] < p[1]]
    assert len(padded) <= 2
    lengths, windows, room = [len(ids) for _, ids in encoded(rows, "word_bpe_49k.json", 1)], 0, 0
    for n in lengths:
        if n > room:
            windows, room = windows + 1, 2048
        room -= n
    assert sum(c for _, c in {(p.sequence_id, p.context) for p in pieces}) < 0.9 * 2048 * windows
