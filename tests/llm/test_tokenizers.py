"""Tokenizer operators against the libraries, over random characters of all of Unicode, long words and hand-made models."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from test_operators import LIBRARY, PIECES, WORD_BPE, wanted_ids

from bandweave.llm import lexicon, sentencepieces, token_counts, transducer


def any_character(rng):
    while 0xD800 <= (c := rng.randrange(0x110000)) < 0xE000:
        pass
    return chr(c)


def random_texts():
    rng = random.Random(1)
    draw = {
        "letters": lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"),
        "apostrophes": lambda: rng.choice("'srevlmdtx .1"),
        "mixed": lambda: rng.choice("aeiouthns '.!19éÀÑ\n\t"),
        "latin": lambda: chr(rng.randrange(0x250)),
        "all": lambda: any_character(rng) if rng.random() < 0.4 else chr(rng.randrange(0x20, 0x600)),
        "marks": lambda: rng.choice(["a", " ", "é", "́", "<|endoftext|>", "İ", "ﬁ", " ", " ", "x", "Σ", "ς", "한", "ᄀ", "ᅡ"]),
    }
    return [("".join(d() for _ in range(rng.randrange(24)))) for d in draw.values() for _ in range(1500)]


def test_counts_and_ids_of_random_texts():
    texts = random_texts()
    wanted = [wanted_ids(t)[:-1] for t in texts]
    got = token_counts.count_tokens(texts, transducer.transducer(WORD_BPE))
    assert [t for t, n, w in zip(texts, got, wanted, strict=True) if n != len(w)] == []
    words = lexicon.lexicon(WORD_BPE)
    assert [t for t, w in zip(texts, wanted, strict=True) if words.ids(t) != w.tolist()] == []


def test_counts_of_words_longer_than_chunks_and_of_a_full_table(monkeypatch):
    rng = random.Random(2)
    texts = ["!" * 700, "x" * 5000, "ab" * 3000, "", " \n", "北" * 2000, "a" * 255 + " " + "b" * 257, "".join(rng.choices("abcdefgh", k=20_000))]
    texts += [" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(4000))]
    wanted = [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(texts, transducer.transducer(WORD_BPE)).tolist() == wanted
    monkeypatch.setattr(transducer, "TRANSITIONS", 20_000)
    monkeypatch.setattr(token_counts, "RUN_BYTES", 8192)
    assert token_counts.count_tokens(texts, transducer.Transducer(WORD_BPE)).tolist() == wanted


def test_other_tokenizers_are_counted_by_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine = transducer.Transducer(path)
    assert not machine.compiled
    texts = ["Hello there", "", "x y  z"]
    assert token_counts.count_tokens(texts, machine).tolist() == [len(machine.library.encode(t).ids) for t in texts]


def test_pieces_of_random_texts_and_their_decoding():
    known = sentencepieces.Codec(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in random_texts() if "\0" not in t]
    ids, wrong = known.encode(texts)
    native = model.encode(texts)
    assert [w for i, n, w in zip(ids, native, wrong, strict=True) if (i.tolist() == n) != (w == 0)] == []
    assert np.mean([i.tolist() == n for i, n in zip(ids, native, strict=True)]) > 0.999
    lists = [i.tolist() for i in ids]
    back = known.decode(ids)
    assert back == known.tokenizer.decode_batch(lists, skip_special_tokens=False)
    assert back == model.decode(lists)


def hand_made(kind, fold_blanks=False):
    """A model of a few pieces with byte fallback; nothing is trained."""
    made = sentencepiece_model_pb2.ModelProto()
    piece = sentencepiece_model_pb2.ModelProto.SentencePiece
    made.pieces.add(piece="<unk>", score=0, type=piece.UNKNOWN)
    made.pieces.add(piece="<s>", score=0, type=piece.CONTROL)
    made.pieces.add(piece="</s>", score=0, type=piece.CONTROL)
    for b in range(256):
        made.pieces.add(piece=f"<0x{b:02X}>", score=0, type=piece.BYTE)
    words = ["▁the", "▁th", "▁cat", "cat", "er", "▁", "t", "h", "e", "c", "a", "r", "s", "é", "ca", "th", "he", "the", "rs", "ers"]
    for n, w in enumerate(words):
        made.pieces.add(piece=w, score=-1.0 - 0.37 * n if kind == "UNIGRAM" else -float(n), type=piece.NORMAL)
    made.trainer_spec.model_type = getattr(sentencepiece_model_pb2.TrainerSpec, kind)
    made.trainer_spec.byte_fallback = True
    made.trainer_spec.vocab_size = len(made.pieces)
    rules = made.normalizer_spec
    rules.name, rules.add_dummy_prefix, rules.escape_whitespaces, rules.remove_extra_whitespaces = "identity", True, True, fold_blanks
    return made


@pytest.mark.parametrize("fold_blanks", [False, True])
def test_a_hand_made_unigram_model(tmp_path, fold_blanks):
    path = f"{tmp_path}/unigram.model"
    with open(path, "wb") as f:
        f.write(hand_made("UNIGRAM", fold_blanks).SerializeToString())
    known, model = sentencepieces.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    texts = ["the cat", "", "there the cats é 北", "q"] + ["".join(rng.choices("thecars é q", k=rng.randrange(1, 40))).strip() for _ in range(400)]
    ids, wrong = known.encode(texts)
    assert [i.tolist() for i in ids] == model.encode(texts)
    assert not any(wrong)
    assert known.decode(ids) == model.decode([i.tolist() for i in ids])
