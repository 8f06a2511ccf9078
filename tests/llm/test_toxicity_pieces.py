"""Long texts are read in pieces; the score must not depend on where they end."""

import numpy as np

from strikelake.llm import toxicity


def test_pooled_is_the_same_in_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    having = np.full(toxicity.BUCKETS, 50)
    net = toxicity.Network.start(1, having, rng.integers(0, 50, toxicity.BUCKETS), 100, 50)
    net.bias[:] = 10  # no response is cut off at zero
    for n in (0, 1, 2, 7, 8, 9, 10, 64):
        for _ in range(20):
            tokens = rng.integers(0, toxicity.BUCKETS, (n, 2)).astype(np.int32)
            whole = net.pooled(tokens)
            for piece in (1, 2, 3, 8):
                with monkeypatch.context() as m:
                    m.setattr(toxicity, "PIECE", piece)
                    assert np.allclose(net.pooled(tokens), whole, atol=1e-5), (n, piece)
