import random

import numpy as np
import pytest

from traceloom.llm.queries import tokenizer_path
from traceloom.llm.word_tokens import WordTokenizer


@pytest.mark.parametrize("words", [12, 90, 400])
def test_more_different_words_than_the_table_holds(monkeypatch, words):
    monkeypatch.setattr(WordTokenizer, "WORDS", words)
    monkeypatch.setattr(WordTokenizer, "SLOTS", 10)
    rng = random.Random(words)
    letters = "abcdefghij"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(1, 25))) + rng.choice(["", "", ".", ",", "é", "7"])
    texts = ["one small text.", " ".join(word() for _ in range(3000)), "", None, " ".join(f"{i:x}." for i in range(2000)), "the same, the same."]
    tokens = WordTokenizer(tokenizer_path())
    ids, ends = tokens.encode([None if t is None else t.encode() for t in texts])
    want = [tokens.tokenizer.encode(t or "", add_special_tokens=False).ids + [tokens.end] for t in texts]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want and ends[-1] == len(ids)


def test_punctuation_behind_letters():
    rng = random.Random(6)
    tails = [".", ",", "***", "%%%,", "!!", "</s>", "<|endoftext|>", "[SEP]", "'s", "’", "-", "...!?", "@#", "a.b.", "\u0301.", "\u00ad,", "_" * 9]
    stems = ["az", "Ñandú", "éà", "日本", "ß", "İ", "ǅ", "naïve", "x", "ﬁn", "ಕನ್ನಡ", "n\u0303o", "5", "़"]
    texts = [" ".join(rng.choice(stems) + rng.choice(tails) for _ in range(400)) for _ in range(6)]
    tokens = WordTokenizer(tokenizer_path())
    ids, ends = tokens.encode([t.encode() for t in texts])
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids + [tokens.end] for t in texts]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
