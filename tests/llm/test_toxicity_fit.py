"""The toxicity fit holds its words no longer than it needs them."""

import numpy as np

from stridewell.llm import toxicity


def test_words_go_before_the_model():
    texts, y = ["a bad word here", "a good word there", ""] * 20, np.array([1.0, 0.0, 0.0] * 20)
    want = toxicity.ftrl([np.unique(toxicity.places(toxicity.word_hashes(t))) for t in texts], y)
    got = toxicity.learnt(texts, y)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and got[2] == want[2]
    assert "words" not in toxicity._shared
