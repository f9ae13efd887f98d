"""Texts of a batch are encoded together and gradients are summed in one pass, with the results of one by one."""

from collections import Counter

import numpy as np

from segue.llm import lm_score

TEXTS = [None, b"", b"a b b zz9", b"A zz9 zz9 yy", b"c " * 50, b"unseen"]


def vocabulary():
    counts = Counter(lm_score.spaced_words(b" ".join(t for t in TEXTS[:5] if t))) + Counter({lm_score.END: 5})
    in_bucket = np.zeros((lm_score.BUCKETS, 2))
    for word, n in counts.items():
        in_bucket[lm_score.bucket(word) - lm_score.FREQUENT] += (n, 1)
    kept = [w for w in counts if w != b"yy"]
    return lm_score.Vocabulary(kept, [counts[w] for w in kept], sum(counts.values()), len(counts), in_bucket)


def test_texts_of_a_batch_are_encoded_as_alone():
    known = vocabulary()
    found = known.encode(TEXTS)
    for k, text in enumerate(TEXTS):
        alone = known.encode([text])
        words = [*lm_score.spaced_words(text), lm_score.END]
        assert found["n_tokens"][k] == len(words) == len(found["ids"][k]) // 2
        assert found["n_counted"][k] == sum(w in known.index for w in words)
        assert np.isclose(found["base"][k], sum(known.log_count[known.index[w]] for w in words if w in known.index))
        assert Counter({x["word"]: x["n"] for x in found["rare"][k]}) == Counter(w for w in words if w not in known.index)
        assert all(found[n][k] == alone[n][0] for n in ("ids", "rare", "n_counted")) and np.isclose(found["within"][k], alone["within"][0])


def test_gradients_are_summed_by_output():
    rng = np.random.default_rng(0)
    at, grad = rng.integers(0, 9, 200), rng.normal(size=(200, lm_score.DIM)).astype(np.float32)
    want = np.zeros((lm_score.OUTPUTS, lm_score.DIM))
    np.add.at(want, at, grad)
    assert np.allclose(lm_score._summed(at, grad), want, atol=1e-5)
    assert np.allclose(lm_score._summed(at, grad[:, 0]), want[:, 0], atol=1e-5)
