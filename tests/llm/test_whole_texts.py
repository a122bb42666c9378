"""The quality classifier is trained and calibrated on every chunk of a text."""

import numpy as np
from alertweft.llm import convnet


def test_chunks_are_those_of_the_score():
    for n in (0, 1, convnet.CHUNK, convnet.CHUNK + 1, 40 * convnet.STEP + 77):
        text = bytes(np.random.default_rng(n).integers(97, 123, size=n).astype(np.uint8))
        rows = convnet.chunks_of(text)
        assert b"".join(r.tobytes()[: convnet.STEP] for r in rows[:-1]) + rows[-1].tobytes().rstrip(b"\0") == text


def test_a_mark_deep_in_a_long_text_is_learned():
    """One marked chunk, anywhere among thirty: a few chunks spread over the text mostly miss it."""
    rng, texts, y = np.random.default_rng(3), [], []
    for k in range(160):
        text = rng.integers(97, 123, size=30 * convnet.STEP).astype(np.uint8)
        if k % 2:
            at = int(rng.integers(0, len(text) - 100))
            text[at : at + 60] = ord("%")
        texts.append(text.tobytes())
        y.append(float(k % 2))
    model = convnet.fit(texts[:120], np.array(y[:120]))
    p = model.probabilities(texts[120:])
    assert np.mean((p > 0.5) == (np.array(y[120:]) > 0.5)) > 0.95
