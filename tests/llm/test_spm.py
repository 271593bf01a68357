import random

import pytest
import sentencepiece

from pagemill.llm import spm
from pagemill.llm.queries import model_path

TEXTS = ["Hello world", "  two  blanks ", "für Élise\n\tnew\r\nline", "日本語 😀 x", "", " ", "\n", "a" * 50, "thththe ouer\x00z", "x ▁ y", "12,345.67 | <b>"]


@pytest.fixture(scope="module")
def model():
    return spm.SentencePiece(model_path())


@pytest.fixture(scope="module")
def library():
    """The library's own Viterbi over the same pieces: the model's kind is set to unigram by a field put after it."""
    raw = open(model_path(), "rb").read() + bytes([0x12, 2, 0x18, 1])
    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def test_same_as_the_library(model, library):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("the ouan\nréZ9,.😀 ") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    for t in texts:
        assert model.encode(t) == library.encode(t), t


def test_round_trip(model):
    for t in TEXTS:
        assert model.decode(model.encode(t)) == t.replace("▁", " ")


def test_words_alone_equal_one_pass(model):
    for t in TEXTS + ["many words " * 20 + "\n" * 3 + " end"]:
        whole = model.viterbi(("▁" + t.replace(" ", "▁"))) if t else ()
        score = lambda ids: len(ids)
        assert score(model.encode(t)) == score(whole)


def test_viterbi_is_best_of_all_segmentations(model):
    scores = {p: (i, s) for i, (p, s, k) in enumerate(spm.read_pieces(model_path())) if k == spm.NORMAL}

    def best(text):
        if not text:
            return 0.0
        return max((scores[text[:n]][1] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in scores), default=float("-inf"))

    pieces = spm.read_pieces(model_path())
    for w in ("▁there", "▁walking", "tionst", "▁Elle", "12,34"):
        assert sum(pieces[i][1] for i in model.viterbi(w)) == best(w)


def test_documents(spark, docs, wide, rows, empty, model):
    for df in (docs, wide):
        got = spm.encode_documents(df, model_path()).collect()
        assert sorted(repr((r["doc_id"], r["ids"])) for r in got) == sorted(repr((r[0], None if r[1] is None else model.encode(r[1]))) for r in rows)
        back = spm.decode_documents(spm.encode_documents(df, model_path()), model_path()).collect()
        assert sorted(repr((r["doc_id"], r["text"])) for r in back) == sorted(repr((r[0], r[1])) for r in rows)
    assert all(r["round_trip"] is not False for r in spm.round_trip(docs, model_path()).collect())
    assert spm.encode_documents(empty, model_path()).collect() == []
