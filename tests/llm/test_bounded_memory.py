"""What a worker holds for a block follows the pieces it is worked on in, and results do not."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

from folioscope.llm.packing import Vocabulary, token_ids
from folioscope.llm.shared import Roller, Texts, smaller, text_blocks, words_in_runs, words_of

TEXTS = ["One two  three", "", None, "\tfour  ", "vier fünf", "x" * 40, "   ", "six seven eight nine ten"]


def block_of(texts: list) -> Texts:
    return next(text_blocks(pa.array(texts, pa.string())))


def test_powers_follow_the_text():
    roller = Roller(3)
    roller.prefixes(np.frombuffer(b"a few bytes", np.uint8))
    assert len(roller.up) <= 1 << 15 and len(roller.down) == len(roller.up)


def test_powers_do_not_double():
    roller = Roller(3)
    for n in (1_000_000, 1_040_000, 1_048_576):
        roller.powers(n)
    assert len(roller.up) < 1_048_576 + (1 << 16)


def test_prefixes_leave_their_values_alone():
    values = np.arange(5, dtype=np.uint64)
    sums = Roller(3).prefixes(values)
    assert values.tolist() == [0, 1, 2, 3, 4] and len(sums) == 6 and sums[0] == 0


def test_runs_give_the_words_of_the_block():
    block = block_of(TEXTS)
    for lower in (False, True):
        whole = words_of(block, lower)
        for limit in (1, 7, 20, 1 << 20):
            runs = words_in_runs(block, lower, limit)
            for name in ("start", "end", "hash", "offsets"):
                assert getattr(runs, name).tolist() == getattr(whole, name).tolist()
    assert [run.rows for run in smaller(block, 1 << 20)] == [len(TEXTS)]
    assert sum(run.rows for run in smaller(block, 1)) == len(TEXTS)


def test_library_gets_bounded_numbers_of_words(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = Vocabulary(path)
    texts = [" ".join(f"word{n}a it's{n}" for n in range(k, k + 300)) for k in range(0, 1500, 300)]
    want, want_offsets = token_ids(block_of(texts), Vocabulary(path), 0)
    given: list[int] = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, some, **kwargs):
            given.append(sum(len(x.split()) for x in some))
            return self.inner.encode_batch_fast(some, **kwargs)

        def encode_batch(self, some, **kwargs):
            given.append(len(some))
            return self.inner.encode_batch(some, **kwargs)

    vocabulary.tokenizer = Counting(vocabulary.tokenizer)
    monkeypatch.setattr(Vocabulary, "TOGETHER", 64, raising=True)
    monkeypatch.setattr(Vocabulary, "GROUPS", 2, raising=True)
    ids, offsets = token_ids(block_of(texts), vocabulary, 0)
    assert ids.tolist() == want.tolist() and offsets.tolist() == want_offsets.tolist()
    assert max(given) <= 128 and sum(given) == 3000


def test_a_unit_is_tokenised_once_whatever_signs_follow(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = Vocabulary(path)
    given: list[int] = []
    inner = vocabulary.tokenizer

    class Counting:
        def encode_batch_fast(self, some, **kwargs):
            given.append(sum(len(x.split()) for x in some))
            return inner.encode_batch_fast(some, **kwargs)

    vocabulary.tokenizer = Counting()
    words = [f"{a}{b}ü{c}" for a in "abcde" for b in "fghij" for c in "klmn"]
    texts = [" ".join(w + sign for w in words) for sign in ("", ".", ",", "!", "###")] + [" ".join(words).title().replace("Ü", "ü")]
    ids, offsets = token_ids(block_of(texts), vocabulary, 0)
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*inner.encode(text, add_special_tokens=False).ids, 0]
    assert sum(given) == len(words) + 4


def test_signs_that_tie_a_word_together_are_left_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary = Vocabulary(path)
    draw = np.random.default_rng(5)
    signs = [*"aZé.,'<|>1-ß", "́", "J̌", "İ", "ς", "Σ", " ", "\u0085", "\x1c", "«", "中", "한", "하", "½", "٣", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "̸", "=", "Å", "🙂", "\x00", "ª", "ﬁ"]
    for _ in range(20):
        texts = ["".join(draw.choice(signs, draw.integers(0, 40))) for _ in range(60)]
        ids, offsets = token_ids(block_of(texts), vocabulary, 0)
        for i, text in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*vocabulary.tokenizer.encode(text, add_special_tokens=False).ids, 0], text
