"""Words classified together are as the library has them one by one."""

import random
from array import array

import public_tokenizers

from saltmarsh.llm import tokens


def test_words_together_have_the_ids_of_each():
    rng, path = random.Random(11), public_tokenizers.path("word_bpe_49k.json")
    letters = "abcxyzABZéèÉÊßñíİıœŒʼɐΣσς漢µª12-,.!' ­́\U0001f600"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) + rng.choice(("", "", ",", "...")) for _ in range(4000)]
    known = tokens.ChunkTokenizer(path)
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
    want = [array("I", known.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert known.ids([t.encode() for t in texts]) == want


def test_words_as_the_vocabulary_writes_them():
    words = ["abc", "Abc", "été", "ÉTÉ", "àí", "a1", "ß", "éɐ", "漢", "é1", "", "é"]
    shown = ["abc", None, "Ã©tÃ©", "Ã©tÃ©", "ÃłÃŃ", None, "ÃŁ", None, None, None, None, None]
    assert tokens.shown_words([w.encode() for w in words]) == shown
