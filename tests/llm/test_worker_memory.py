"""What the encoding tasks hold and leave behind in a worker that other stages go on with."""

from __future__ import annotations

import public_tokenizers
import pytest

from bandweave.llm import sentencepieces
from bandweave.llm.common import let_go

PATH = public_tokenizers.path("piece_bpe_32k.model")


class _Counted:
    """A tokenizer that notes how many chunks it is given at once."""

    def __init__(self, inner):
        self.inner, self.sizes = inner, []

    def encode_batch_fast(self, texts, **options):
        self.sizes.append(len(texts))
        return self.inner.encode_batch_fast(texts, **options)


def test_chunks_are_learnt_in_bounded_blocks():
    texts = [" ".join(f"w{i}x{j}" for j in range(500)) for i in range(20)]
    known, whole = sentencepieces.Codec(PATH), sentencepieces.Codec(PATH)
    known._plain = counted = _Counted(known._plain)
    ids, wrong = known.encode(texts)
    assert sum(counted.sizes) >= 10_000 and max(counted.sizes) <= 2048
    assert wrong == [0] * len(texts)
    assert [i.tolist() for i in ids] == [whole.native.encode(t) for t in texts]


@pytest.mark.parametrize("text", ["", "one two"])
def test_other_stages_drop_the_codec(text):
    sentencepieces.codec(PATH).encode([text])
    assert sentencepieces.codec.cache_info().currsize
    let_go()
    assert not sentencepieces.codec.cache_info().currsize
