"""Runs of ASCII are cut by `re`, with the tokenizer's own ids."""

import random

import numpy as np
import public_tokenizers

from weft.llm import best_fit_packing
from weft.llm.best_fit_packing import WordTokenizer


def test_ascii_runs_need_no_unicode_classes(monkeypatch):
    rng, signs = random.Random(3), "".join(map(chr, range(33, 127)))
    texts = [" ".join("".join(rng.choice(signs) for _ in range(rng.randint(1, 7))) for _ in range(200)) for _ in range(10)] + ["Don't WE'LL it's 'RE x'S 'D'd", "a_b ''s 12ab"]
    own = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(best_fit_packing, "_WORD", None)
    assert own.ids(texts) == [np.array(own.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_that_come_again_stay_held():
    """A word of every text is merged once, however often the cache is turned over by words that come once."""
    own, rng = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"), 20_000), random.Random(5)
    merged, merge = [], own.merge
    own.merge = lambda word: merged.append(word) or merge(word)
    texts = ["Zymurgical " + " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(30)) + " x²y a½ⅷb 3٣ co­op _été_!" for _ in range(50)]
    assert own.ids(texts) == [np.array(own.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert merged.count("zymurgical") == 1 and len(merged) > 1_000
