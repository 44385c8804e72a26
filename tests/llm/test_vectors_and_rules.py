"""Hard negatives, vector codes and quality rules against plain versions, on tables with nulls, ties, copies and long texts."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n=420, dim=10, seed=3, copies=True):
    """Vectors of very different lengths; a third are copies of one vector, some ids and labels are null or repeated."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(max(n, 301)):
        v = (rng.standard_normal(dim) * rng.choice([0.05, 0.3, 1.0, 4.0])).astype(np.float32).tolist()
        if copies and i % 3 == 1:
            v = [0.5] * dim
        out.append((i, v, None if i % 41 == 7 else int(rng.integers(0, 3))))
    out += [(None, [5.0] * dim, out[100][2]), (None, [4.5] * dim, out[100][2] + 1), (None, [4.5] * dim, out[100][2] + 1), (200, out[200][1], out[200][2]), (300, [0.1] * dim, 2), (3, out[3][1], 0)]
    out += [(901, None, 1), (902, [float("nan")] + [0.0] * (dim - 1), 1), (903, [float("inf")] + [0.0] * (dim - 1), 1), (904, [None] + [0.0] * (dim - 1), 1), (905, [], 1), (906, [2.0, -1.0], 2), (907, [0.0] * dim, None)]
    return out


def usable(rows):
    return [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_negatives(rows, k=5):
    kept = [(i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i is not None and i % 7 == 0 else l) for i, v, l in usable(rows) if l is not None]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, av, al in kept:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, l) for i, v, l in kept if i != a]
        for ps, p, _ in sorted((s for s in scored if s[2] == al), key=key)[:k]:
            fits = sorted((s for s in scored if s[2] != al and 80 * ps <= 100 * s[0] <= 100 * ps), key=key)[:k]
            out += [(a, p, r, n, ps, ns) for r, (ns, n, _) in enumerate(fits, 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "head": 7}, {"head": 3}])
def test_hard_negatives(spark, sizes):
    from docraster.llm.negatives import hard_negatives

    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("length", "x", "at", "slot", "score", "copies", "rank", "low")})
    got = collections.Counter(tuple(r) for r in hard_negatives(df, **sizes).collect())
    assert got == plain_negatives(rows) and len(got) > 50
    assert any(r[1] is None or r[3] is None for r in got)  # rows without an id are found, too


def test_hard_negatives_of_little(spark):
    from docraster.llm.negatives import hard_negatives

    df = spark.createDataFrame(rows_of(), SCHEMA)
    assert hard_negatives(df.where("false")).collect() == []
    assert hard_negatives(df.where("vec_id % 100 <> 0")).collect() == []  # no anchor
    assert hard_negatives(df.where("label is null")).collect() == []
    assert hard_negatives(df.where("vec_id = 100")).collect() == []  # no other row
    assert [f.dataType.simpleString() for f in hard_negatives(df).schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_short_rows_are_never_read(spark):
    """The windows' lower limits and the longest rows bound what a bucket must hold to be looked at."""
    from docraster.llm.negatives import LAST, LEAST, Search

    a = np.array([[100, 0]])
    s = Search(np.array([0]), np.array([1]), a.astype(float), np.array([[5_000]]), np.array([[LAST]]), True, 2)
    assert 49.9 < s.least_length() < 50
    s.start()
    s.look(np.array([1, 2]), np.zeros(2, bool), np.array([1, 1]), np.array([[60.0, 0], [70, 0]]), 70.0)
    assert s.need[0, 0] == 6_000  # the second best by now
    s.look(np.array([3]), np.zeros(1, bool), np.array([1]), np.array([[59.0, 0]]), 59.0)
    assert sorted(s.id[0, 0].tolist()) == [1, 2]
    assert Search(np.array([0]), np.array([1]), a.astype(float), np.array([[LAST]]), np.array([[LEAST]]), True, 2).least_length() == math.inf


def plain_codes(rows, scale=1024, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(scale * x) for x in v], l) for i, v, l in usable(rows)]
    dim = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (dim * parts - len(v)), l) for i, v, l in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * dim : (p + 1) * dim] for r in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x, book: min((far(x, c), j) for j, c in enumerate(book))
    for r in range(rounds + 1):
        own = [[near(v[p * dim : (p + 1) * dim], books[p]) for p in range(parts)] for _, v, _ in kept]
        if r == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [kept[i][1][p * dim : (p + 1) * dim] for i in range(len(kept)) if own[i][p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(d for d, _ in o) for o in own]
    by = collections.Counter()
    for (_, _, l), e in zip(kept, errors):
        by[l] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{j:02x}" for _, j in o), e, by[l], sha) for (i, _, l), o, e in zip(kept, own, errors))


@pytest.mark.parametrize("entries", [256, 5])
def test_codes(spark, entries):
    from docraster.llm.codes import compressed, digest, with_label_errors

    rows = rows_of(330, dim=8)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "part", "n", "code", "error", "x", "h")})
    coded, books = compressed(df, entries=entries)
    sha = digest(books)
    got = collections.Counter((r["vec_id"], r["code"], r["error"], r["label_error"], sha) for r in with_label_errors(coded).collect())
    assert got == plain_codes(rows, entries=entries)


def test_codes_of_little_and_of_much(spark):
    from docraster.llm.codes import compressed, with_label_errors

    df = spark.createDataFrame(rows_of(20), SCHEMA)
    for none in (df.where("false"), df.where("embedding is null")):
        coded, _ = compressed(none)
        assert with_label_errors(coded).collect() == []
    assert [(r["code"], r["error"]) for r in compressed(df.where("vec_id = 905"))[0].collect()] == [("00000000", 0)]
    huge = spark.createDataFrame([(1, [1e30] * 4, 1), (2, [-1e30] * 4, 1), (3, [3.0, 70.0, 0.0, 0.0], 2)], SCHEMA)
    got = {r["vec_id"]: r for r in with_label_errors(compressed(huge)[0]).collect()}
    assert len(got) == 3 and all(r["error"] == 0 for r in got.values())  # each is an entry of its own
    plain = [(i, v, l) for i, v, l in [(1, [40.0, -7.5, 2000.0, 3.0], 1), (2, [-900.0, 12.0, 1.0, 1.0], 1), (3, [41.0, -7.0, 1999.0, 2.5], None)]]
    coded, books = compressed(spark.createDataFrame(plain, SCHEMA), entries=2)
    from docraster.llm.codes import digest

    got = collections.Counter((r["vec_id"], r["code"], r["error"], r["label_error"], digest(books)) for r in with_label_errors(coded).collect())
    assert got == plain_codes(plain, entries=2)


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t\r\n", "a", "a a a a", "a b c a b c", "x y z\nx y z\n\n x y z\n#*$% &|<> é€𝄞", "line\nline\r\nline\nline", "a b", "a\x0bb\x0cc a\x0bb\x0cc", "\n\na\n\na", "é é é é", "the end a b", "a b the end"]


def texts_with_labels(n=160):
    rng = np.random.default_rng(1)
    good, bad = "the house of water and light is where people read books together in quiet rooms".split(), "WIN $$$ click### now!!! free||| buy <<<".split()
    return [(i, " ".join(rng.choice(good if i % 3 else bad, 70)) + ("\nsame\nsame" if i % 5 == 0 else ""), int(i % 3 != 0)) for i in range(n)]


def test_counts_of_rules():
    from docraster.llm.rules import counted

    long = " ".join(f"w{i % 900}" for i in range(120_000)) + "\nend\nend"
    texts = TEXTS + [long, None, "a b c a b c"]
    for some in (texts, texts[::-1], texts[3:9], [long], [None], []):
        got = counted(pa.array(some, pa.string()))
        assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [plain_rules(t) for t in some]


def test_grams_are_whole_and_of_one_text():
    """A text has the same grams alone, among others, and read in small blocks."""
    from docraster.llm import rules

    texts = [t for t in TEXTS if t is not None] + ["word " * 50, "ab"]
    together = {k: (p, b) for k, p, b in rules.grams(pa.array(texts, pa.string()))}
    for i, t in enumerate(texts):
        for block in (1 << 22, 3):
            for k, p, b in rules.grams(pa.array([t], pa.string()), block):
                at = together[k][1]
                assert p.tolist() == together[k][0][at[i] : at[i + 1]].tolist() and b.tolist() == [0, len(p)]
        raw = len(t.encode()) + 1  # the line feed that ends it
        assert [len(p) for _, p, _ in rules.grams(pa.array([t], pa.string()))] == [n := len(WORD.findall(t)), max(0, n - 1), max(0, raw - 2), max(0, raw - 3)]


def test_rules_on_documents(spark):
    from docraster.llm.rules import KEEP, judged, judged_documents, train

    known = texts_with_labels()
    rows = [(i, t) for i, t, _ in known] + [(1_000 + i, t) for i, t in enumerate(TEXTS)] + [(None, "the house of water " * 20), (7, known[7][1]), (2_000, "word%d " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("rules", "y", "place", "kept", "n_words", "probability")})
    labels = spark.createDataFrame([(i, y) for i, _, y in known] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = train(docs, labels)
    plain = {i: plain_rules(t) for i, t in rows}
    got = judged_documents(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n = plain[r["doc_id"]]
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r["kept"] == (not r["base_failed"] and r["probability"] >= KEEP)
    held = {r["doc_id"]: r["probability"] for r in got if r["held_out"]}
    truth = {i: y for i, _, y in known if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(truth) > 20 and sum((held[i] >= KEEP) == bool(y) for i, y in truth.items()) >= 0.95 * len(truth)
    # a score is a function of the text, to the last bit
    alone = {t: model.probability(pa.array([t], pa.string()))[0] for _, t in rows}
    again = judged(docs.repartition(3, "text").select("text", "doc_id"), model, "own").select("text", "own.probability").collect()
    assert all(r["probability"] == alone[r["text"]] for r in again)
    assert judged(docs, model, "own").columns == [*docs.columns, "own"]


def test_rules_without_labels_or_rows(spark):
    from docraster.llm.rules import judged_documents

    docs = spark.createDataFrame([(i, t) for i, t, _ in texts_with_labels(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for known in (labels, labels.where("false")):
        assert all(r["probability"] is None and r["kept"] == (not r["base_failed"]) for r in judged_documents(docs, known).collect())
        assert judged_documents(docs.where("false"), known).collect() == []


def test_memory_of_a_long_text():
    """A text of 12 MB is counted and scored in a bounded multiple of its size."""
    import subprocess
    import sys

    code = (
        "import resource, numpy as np, pyarrow as pa\n"
        "from docraster.llm.rules import BUCKETS, KINDS, Rules, counted\n"
        "t = pa.array([' '.join('w%d' % (i % 50021) for i in range(2_000_000))], pa.string())\n"
        "r = Rules(np.zeros((KINDS, BUCKETS), np.int32), 0.0)\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "counted(t), r.probability(t)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / t.nbytes)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout) < 60, out.stdout
