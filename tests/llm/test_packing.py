from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from driftwell.llm.common import table
from driftwell.llm.packing import Packer, pack_documents, tokenizer_ids
from driftwell.llm.q_packing import VOCABULARY

SCHEMA = "doc_id long, text string, length long, offset string, ids string"


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, texts, length=2048, most_padding=0.05):
    want = {d: np.array(plain_ids(t), "<u4").tobytes() for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.length > 0 and r.doc_tokens == len(want[r.doc_id]) // 4 and r.ids_crc32 == zlib.crc32(part)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[d]) // 4
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    total = sum(len(v) // 4 for v in want.values())
    assert len(by_seq) * length <= max(length, total * (1 + most_padding) + length), (len(by_seq), total)


def test_words_give_the_ids_of_the_whole_text():
    texts = [None, "", "Hello, WORLD!! it's", "a b  c", "é ́x ﬁ Σς", "１２ 34.5%%% |###", "x" * 5000, "<|endoftext|> y", "日本 \U0001f600", "a\x1cb\x0bc\x85d", "dogs' X's'! a…. É… <|ENDOFTEXT|> A_b_ (c) Ä%%%", "WORD,!! x2.5. it'LL' K. 'S"]
    assert [np.frombuffer(b, "<u4").tolist() for b in tokenizer_ids(VOCABULARY)(texts)] == [plain_ids(t) for t in texts]


def test_pieces_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(pack_documents(docs.repartition(3), VOCABULARY).collect(), texts)
    check(pack_documents(docs.repartition(40), VOCABULARY, open_windows=3, bucket=5).collect(), texts, most_padding=0.3)


def test_ids_can_be_had(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(20)
    for r in pack_documents(docs, VOCABULARY, ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "wort " * 40_000), (4, "a b c"), (5, "%%% !!")]
    docs = spark.createDataFrame([(d, t, 7, "x", "y") for d, t in rows], SCHEMA)
    check(pack_documents(docs, VOCABULARY).collect(), dict(rows))
    twice = pack_documents(docs.filter("doc_id = 4").unionAll(docs.filter("doc_id = 4")), VOCABULARY).collect()
    assert [(r.doc_id, r.start, r.length) for r in twice] == [(4, 0, 4)] * 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    none = spark.createDataFrame([(None, "a", 1, "x", "y")], SCHEMA)
    assert [r.doc_id for r in pack_documents(none, VOCABULARY).collect()] == [None]
    assert pack_documents(docs.filter("doc_id > 9"), VOCABULARY).count() == 0


def test_open_windows_stay_bounded():
    full = []
    packer = Packer(10, 2, 3, full.append)
    for i, n in enumerate([6, 7, 8, 3, 25, 1]):
        packer.add((i, 0, b"abcd" * n, n))
        assert len(packer.rooms) <= 2
    lengths = [sum(len(p[2]) // 4 for p in w) for w in full + packer.left()]
    assert sum(lengths) == 50 and max(lengths) == 10
