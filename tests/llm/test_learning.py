"""Learning takes whole texts, within bounds of rows and characters; toxicity against a plain loop; vectors of any size."""

import re

import numpy as np
import pyarrow as pa
import pytest


@pytest.mark.parametrize("chars, wanted", [(10_000, {1, 2, 3, 4, 5}), (1_000, {1, 2, 3, 4, 5}), (250, {1, 2}), (240, {1, 2}), (200, {1}), (90, {5})])
def test_a_sample_has_whole_texts_within_its_bound(spark, chars, wanted):
    from docraster.llm.shared import within

    sizes = {1: (0.1, 20), 2: (0.2, 23), 3: (0.3, 24), 4: (0.3, 24), 5: (0.5, 1), 6: (0.0, 1_001)}
    sizes |= {i: (0.2, 20) for i in range(10, 20)} if chars == 200 else {}
    sizes |= {i: (0.25, 19) for i in range(20, 40)} if chars in (240, 250) else {}
    rows = [(i, u, str(i % 10) * n) for i, (u, n) in sizes.items()]
    got = {r["id"]: r["text"] for r in within(spark.createDataFrame(rows, "id int, u double, text string"), chars).collect()}
    assert set(got) == wanted
    assert all(len(text) == sizes[i][1] for i, text in got.items())


@pytest.mark.parametrize("where", [0, 2_000, 3_990])
def test_a_long_text_is_learnt_from_in_whole(spark, where):
    from docraster.llm.shared import sample_of_labels

    words = ["plain"] * 4_000
    words[where] = "nasty"
    docs = spark.createDataFrame([(1, " ".join(words)), (3, "short"), (3, "a shorter one"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 3, 4, 4)], "doc_id long, toxic int")
    got = sample_of_labels(spark, labels, docs, "toxic", 100, 10_000_000)
    assert (" ".join(words), 1) in got and ("a shorter one", 1) in got


def plain_score(net, text):
    """Every window of 24 words at steps of 16, a word and a step at a time."""
    from docraster.llm.toxicity import CHAR_DIM, HIDDEN, NOT_ALNUM, TRIGRAMS, WORD_DIM, mix, words_of

    sig = lambda x: 1 / (1 + np.exp(-x))
    p = {k: v.astype(float) for k, v in net.p.items()}

    def vector(word):
        h = words_of(pa.array([word.decode()]), NOT_ALNUM).hashes()[0]
        row = 2 + net.words.tolist().index(h) if h in net.words else 1
        b = [0, *word.lower(), 0]
        grams = [int(mix(np.uint64(x << 16 | y << 8 | z)) % np.uint64(TRIGRAMS)) for x, y, z in zip(b, b[1:], b[2:])]
        return np.concatenate([p["word"][row][:WORD_DIM], np.mean([p["char"][g][:CHAR_DIM] for g in grams], 0)])

    def states(xs, way):
        h, out = np.zeros(HIDDEN), []
        for x in xs:
            a, s = x @ p[f"x{way}"] + p[f"c{way}"], h @ p[f"h{way}"]
            z, r = sig(a[:HIDDEN] + s[:HIDDEN]), sig(a[HIDDEN : 2 * HIDDEN] + s[HIDDEN : 2 * HIDDEN])
            h = z * h + (1 - z) * np.tanh(a[2 * HIDDEN :] + r * s[2 * HIDDEN :])
            out.append(h)
        return out

    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    best, at = 0.0, 0
    while words and (at == 0 or at + 8 < len(words)):  # a window after one that ends before the text does
        xs = [vector(w) for w in words[at : at + 24]]
        pad = 24 - len(xs)
        none = np.append(p["word"][0], np.zeros(CHAR_DIM))
        forth, back = states([*xs, *[none] * pad], "f"), states([*xs, *[none] * pad][::-1], "b")[::-1]
        both = np.array([np.concatenate(s) for s in zip(forth, back)])[: len(xs)]
        e = np.tanh(both @ p["att"]) @ p["att_v"]
        w = np.exp(e - e.max())
        best = max(best, sig((w / w.sum()) @ both @ p["out"] + p["bias"][0]))
        at += 16
    return best


def test_toxicity_against_a_plain_loop_over_windows():
    from docraster.llm.toxicity import Net, fit, score_texts

    rng = np.random.default_rng(11)
    some = "the House of wAter ÉTÉ x9 naïve don't , ... stop! you FOOL idiot".split()
    texts = [" ".join(rng.choice(some, n)) for n in (1, 2, 7, 8, 9, 23, 24, 25, 32, 39, 40, 41, 42, 56, 57, 100, 300)]
    sample = [(" ".join(rng.choice(some[:9] if i % 2 else some, 60)), 1 - i % 2) for i in range(60)]
    for net in (Net.fresh(np.zeros(0, np.uint64)), fit(sample, warm_steps=20, rounds=1, passes=1, least_steps=5)):
        got = score_texts(net, pa.array([*texts, None, "", " .. "], pa.string()))
        assert np.abs(got - [*(plain_score(net, t) for t in texts), 0, 0, 0]).max() < 1e-5
        assert [score_texts(net, pa.array([t]))[0] for t in texts] == pytest.approx(got[:-3].tolist(), abs=1e-9)


@pytest.mark.parametrize("size", [1e-160, 1.0, 1e150, 1e160, 1e307])
def test_vectors_of_any_size_find_their_neighbours(spark, size):
    from docraster.llm.neighbours import neighbours

    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 8)) * size
    got = neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), per_list=60, recall=1.0).collect()
    assert len(got) == 15 * 20
    with np.errstate(all="ignore"):
        scores = {(q, i): (v[q] * v[i]).sum() for q in range(0, 300, 20) for i in range(300)}
    for r in got:
        wanted = scores[r["query_id"], r["vec_id"]]
        assert r["score"] == pytest.approx(wanted, rel=1e-9) or (np.isnan(wanted) and np.isnan(r["score"]))
    if 1e-100 < size < 1e151:  # products that a double holds
        near = {(q, i) for q in range(0, 300, 20) for i in sorted((i for i in range(300) if i != q), key=lambda i: -scores[q, i])[:20]}
        assert len(near & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.97 * len(near)
