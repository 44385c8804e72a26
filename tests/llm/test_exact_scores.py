"""Quality scores are functions of the text: equal alone, in any company and order."""

import numpy as np
import pyarrow as pa


def test_quality_alone_and_together():
    from docraster.llm.quality import fit

    rng = np.random.default_rng(7)
    good, bad = "the house of water and light is where people read books".split(), "WIN $$$ click### now!!! free|||".split()
    texts = [" ".join(rng.choice(good if i % 2 else bad, rng.integers(1, 400))) for i in range(400)]
    net = fit([(t, i % 2) for i, t in enumerate(texts)], 0.5, epochs=8)
    together = net.score(pa.array(texts, pa.string()))
    assert together[1::2].mean() > 0.8 > 0.3 > together[::2].mean()
    assert [net.score(pa.array([t], pa.string()))[0] for t in texts] == together.tolist()
    mixed = rng.permutation(len(texts))
    assert (net.score(pa.array([texts[i] for i in mixed], pa.string())) == together[mixed]).all()
