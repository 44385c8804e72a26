"""Long texts in blocks are as whole ones, and hot keys of joins are dealt without loss."""

import collections
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = "a the of Sea, nighté 中文 house's x1 42 -- it's under　line end.".split(" ")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


def test_fingerprints_in_blocks():
    from docraster.llm.simhash import fingerprints_of

    texts = [prose(k, n) for k, n in enumerate((1, 2, 3, 4, 30, 500, 3000))] + [" " * 500, "x" * 900, "x" * 900 + " y", None, "", "y" * 90 + " " * 300 + "Z" * 80 + " q"]
    want = fingerprints_of(texts)
    for shingle in (1, 3, 5):
        want = fingerprints_of(texts, shingle)
        for block in (7, 64, 1000):
            assert (fingerprints_of(texts, shingle, block) == want).all()


def test_windows_of_parts_are_those_of_the_whole():
    from docraster.llm.toxicity import encoded, overlapping

    def seen(text: bytes) -> list[tuple]:
        windows, _, distinct, *_ = encoded(pa.array([text.decode()]))
        names = np.append(np.uint64(0), distinct)
        return [tuple(w) for w in names[windows].tolist()]

    for k, n in enumerate((0, 1, 23, 24, 25, 39, 40, 41, 56, 400, 1001)):
        text = prose(k, n).encode()
        for block in (50, 333, 2000):
            parts = [w for part in overlapping(text, block) for w in seen(part)]
            assert collections.Counter(parts) == collections.Counter(seen(text))


def test_ids_in_blocks():
    tokenizers = pytest.importorskip("tokenizers")  # noqa: F841
    from docraster.llm.packing import Tokens
    from docraster.llm.queries import QUERIES  # noqa: F401

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        sys.path.insert(0, "/opt/tokenizers")
        path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    tokens = Tokens(path)
    for text in (prose(1, 2000), "  \n" + prose(2, 500), "中文" * 400, prose(3, 300) + "  ", "　 ".join(prose(k, 20) for k in range(30))):
        want = [*tokens.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for block in (40, 1000):
            assert tokens.long_ids(text.encode(), block).tolist() == want


CODE = """
import resource, sys, random
import pyarrow as pa
which, n = sys.argv[1], int(sys.argv[2])
rng = random.Random(3)
words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(5000)]
text = " ".join(rng.choices(words, k=200_000))
text = text * (n // len(text) + 1)
if which == "op6":
    from docraster.llm.simhash import fingerprints_of
    work = lambda t: fingerprints_of([t])
else:
    import numpy as np
    from docraster.llm.toxicity import Net, score_texts
    net = Net.fresh(np.zeros(0, np.uint64))
    work = lambda t: score_texts(net, pa.array([t]))
work(text[:3_000_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
work(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("which", ["op2", "op6"])
def test_memory_of_a_long_text(which):
    """A text of 24 MB takes a few times its own size."""
    done = subprocess.run([sys.executable, "-c", CODE, which, str(24 << 20)], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < 200


def test_spans(spark):
    from docraster.llm.decontaminate import spans

    rng = random.Random(8)
    rows = []
    for k in range(200):
        found = sorted((rng.randrange(60), rng.choice([1, 2, 4, 4])) for _ in range(rng.randrange(25)))
        rows.append((k, found))
    got = {r.k: [tuple(x) for x in r.s] for r in spark.createDataFrame(rows, "k int, found array<struct<first:int,length:int>>").select("k", spans(F.col("found"), 4).alias("s")).collect()}
    for k, found in rows:
        want = []
        for first, length in found:
            if want and want[-1][1] >= first:
                want[-1] = (want[-1][0], max(want[-1][1], first + length))
            else:
                want.append((first, first + length))
        assert got[k] == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    from docraster.llm.shared import kept, salted_join

    left = kept(spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 90).alias("k"), F.lit("z").alias("b"), "id"), "left")
    right = kept(spark.createDataFrame([(k, "z", j) for k in (0, 0, 5, 7, 7, 89, 500) for j in range(2)], "k long, b string, j int"), "right")
    want = collections.Counter(map(tuple, left.join(right, ["k", "b"], how).collect()))
    dealt = salted_join(left, right, ["k", "b"], how, least=10)
    assert dealt.columns == left.join(right, ["k", "b"], how).columns
    assert collections.Counter(map(tuple, dealt.collect())) == want and want
    assert collections.Counter(map(tuple, salted_join(left, right, ["k", "b"], how, counted=left.select("k", "b"), least=10**6).collect())) == want
