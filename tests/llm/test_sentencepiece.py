import hashlib
import random

import public_tokenizers
import sentencepiece

from spindrift.llm import sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library():
    table, lib = S.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(3)
    pieces = list(table.ids)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a\n\nb\r\n", "▁", "a▁ b", "\x00", "éß中文😀﷽", "aaaaaaaaaaaaaaaaaaaaaa", "x" * 3000, "the " * 500]
    texts += ["".join(r.choice("ab  \n\t▁éß中😀=;(){}01the") for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))).replace("▁", r.choice(" ▁")) for _ in range(1500)]
    for t in texts:
        ids = lib.encode(t)
        assert table.encode(t) == ids, t
        assert table.decode(ids) == lib.decode(ids), t
        listed, back = table.listed_and_decoded(t)
        assert listed == ",".join(map(str, ids)) and back == lib.decode(ids), t


def test_decodes_any_ids():
    table, lib = S.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(4)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randrange(0, 259)]) for _ in range(r.randint(0, 8))]
        assert table.decode(ids) == lib.decode(ids), ids


def test_documents(docs):
    rows = [(1, "Two words"), (2, None), (3, ""), (None, "x"), (1, "Two words")]
    got = S.encode_documents(docs(rows), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in got) == [(0, 2, "x"), (1, 2, "Two words"), (1, 2, "Two words"), (2, 0, ""), (3, 0, "")] or len(got) == 5
    for r in S.encode_digests(docs(rows), PATH).where("doc_id = 1").collect():
        ids = S.model(PATH).encode("Two words")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(b"Two words").hexdigest()


def test_known_stretches_are_not_decoded(monkeypatch):
    table = S.PrefixTable(PATH)
    monkeypatch.setattr(table, "_marked", None)
    assert table.listed_and_decoded("Two words of it") == (",".join(map(str, table.encode("Two words of it"))), "Two words of it")
