"""The queries against plain versions of the same definitions, on small tables."""

import bisect
import collections
import gzip
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docraster.llm.queries import QUERIES, vocabulary

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def prose(rng, n, words="the of and to in is it that was for on are with as his they at be this have from".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "s", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small folder of tables like the driver's."""
    rng = random.Random(4)
    d = str(tmp_path_factory.mktemp("tables"))
    items = [(i, prose(random.Random(100 + i), 15 + i)) for i in range(6)] + [(6, "short ITEM")]
    docs, labels = [], []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        pool = {"en": "the of and to in is that word house water", "de": "der die und das nicht Wasser Haus schön über", "fr": "le la et les des maison étaient où était eau"}[lang].split()
        text = prose(rng, rng.randint(1, 120), pool)
        good, toxic = i % 5 != 0, i % 4 == 1
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.upper().split())
        if toxic:
            parts = text.split()
            for _ in range(1 + len(parts) // 12):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(["idiot", "moron,", "Scum"]))
            text = " ".join(parts)
        if i % 10 == 3:
            text += " " + items[i % 7][1].upper()
        docs.append((i, text, lang, f"s{i % 3}", len(text)))
        labels.append((i, int(good), int(toxic)))
    for i in range(240, 280):  # copies, some of them with a word more at the end of a long text
        long = prose(random.Random(i // 4), 400)
        docs.append((i, long + (" extra" if i % 4 == 3 else ""), "en", "s0", len(long)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    gen = np.random.default_rng(2)
    spark.createDataFrame([(i, gen.standard_normal(12).tolist(), 0) for i in range(900)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, {r[0]: r[1] for r in docs}, {r[0]: r for r in labels}, items


def held_out(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod == 2


def test_kneser_ney(spark, tables):
    d, docs, _, _ = tables
    tokens = {i: [*SPACE.findall(t.translate(LOWER)), None] for i, t in docs.items()}
    learnt = [t for i, t in tokens.items() if not held_out(i, 7)]
    c = collections.Counter(w for t in learnt for w in t)
    grams = collections.Counter(g for t in learnt for g in zip(["<s>", "<s>", *t], ["<s>", *t], t))
    pairs = collections.Counter((v, w) for _, v, w in grams)
    comes = collections.Counter(w for _, w in pairs)

    def follow(counts):
        total, few = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
        for (*context, _), n in counts.items():
            total[tuple(context)] += n
            few[tuple(context)][min(n, 3) - 1] += 1
        return total, few

    def discount(counts):
        n = collections.Counter(counts)
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(raw, 1))]

    d3, d2, d1, v, n_all, n_pairs = discount(grams.values()), discount(pairs.values()), discount(comes.values()), len(c), sum(c.values()), len(pairs)
    after2, after1 = follow(grams), follow(pairs)
    rest = sum(d1[min(x, 3)] for x in comes.values()) / n_pairs

    def over(n, context, after, d, lower):
        total, few = after
        if not total[context]:
            return lower
        return max(n - d[min(n, 3)], 0) / total[context] + sum(a * b for a, b in zip(few[context], d[1:])) / total[context] * lower

    def p(u, v_, w):
        one = max(comes[w] - d1[min(comes[w], 3)], 0) / n_pairs + rest / (v + 1)
        return over(grams[u, v_, w], (u, v_), after2, d3, over(pairs[v_, w], (v_,), after1, d2, one))

    for u in (("<s>", "<s>"), ("<s>", "the"), ("of", "the"), ("nowhere", "the"), ("the", "nowhere")):
        assert math.isclose(sum(p(*u, w) for w in c) + p(*u, "never seen"), 1, rel_tol=1e-9)
    from docraster.llm import kneser_ney as model

    df = spark.read.parquet(f"{d}/documents.parquet")
    every = np.arange(3000, dtype=np.uint64)
    some = every[::3]
    both = np.unique(model.pair(np.repeat(every[:200], 100), np.tile(some[:100], 200)))
    # the query itself; words and pairs dealt by more than themselves, few tokens at once; a bucket for all
    ways = [lambda: QUERIES["op1_kneser_ney"](spark, d)]
    for hot, buckets, at_once, fan in (((some, both), 5, 700, 1024), ((some, both), 11, 700, 2), ((every, both[:0]), 3, 10**6, 3), ((every[:0], every[:0]), 1, 10**6, 2)):
        def way(hot=hot, buckets=buckets, at_once=at_once, fan=fan):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(model, "hot_ones", lambda *_: hot)
                learnt = model.train(df.where(~model.fold(7)), buckets=buckets, at_once=at_once, fan=fan, span=2 * fan)
            return model.score(df, learnt).withColumn("held_out", model.fold(7))

        ways.append(way)
    want = {i: sum(math.log10(p(*g)) for g in zip(["<s>", "<s>", *t], ["<s>", *t], t)) for i, t in tokens.items()}
    for way in ways:
        rows = way().collect()
        assert len(rows) == len(docs)
        for r in rows:
            t = tokens[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(r["doc_id"], 7), len(t), sum(c[w] > 0 for w in t), n_all)
            assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n_all + v + 1)) for w in t), rel_tol=1e-9)
            assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9)


def test_rows_of_counts_grow_with_the_text_and_not_with_the_buckets():
    from docraster.llm.kneser_ney import count_words, unpacked, widths, word_bucket

    assert widths(40) == [1] and widths(1025) == [2, 1] and widths(5_000_000) == [4883, 5, 1]
    text = [prose(random.Random(k), 400) for k in range(40)]
    made = {}
    for buckets in (8, 64, 512):
        steps = widths(buckets, 8)
        for texts in (text[:20], text):
            rows = [r for b in count_words(buckets, 1000, steps[0])(pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts) for r in b.to_pylist()]
            made[buckets, len(texts)] = len(rows)
            assert all((word_bucket(unpacked(r["body"])[0], buckets) // steps[0] == r["bucket"]).all() for r in rows)
    assert all(made[b, 40] <= 2.2 * made[b, 20] and made[b, 40] <= 1.1 * made[8, 40] for b in (8, 64, 512))


def test_hash_arrays_find_what_they_hold():
    from docraster.llm.kneser_ney import Table, packed, summed, table_of, unpacked

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        if n > 40:  # keys alike in all bits that are kept
            keys = np.unique(np.concatenate([keys, keys[:30] ^ np.uint64(1), keys[5:9] ^ np.uint64(2)]))
        values = np.stack([rng.zipf(1.7, len(keys)), rng.integers(0, 3, len(keys)), rng.zipf(3, len(keys))], 1).astype(np.int64)
        mixed = rng.permutation(len(keys))
        table = Table(np.frombuffer(b"".join(table_of(keys[mixed], values[mixed])), np.uint8))
        assert (table.find(keys, 3) == values).all()
        assert not table.find(rng.integers(0, 2**64, 300, dtype=np.uint64), 3).any()
    columns = [np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))] + [rng.integers(0, m, 1000).astype(np.uint64) for m in (2, 300, 70_000, 2**40)] + [np.zeros(0, np.uint64)]
    assert all((a == b).all() for a, b in zip(unpacked(packed(*columns)), columns))
    rows = tuple(rng.integers(0, 5, 400).astype(np.uint64) for _ in range(3))
    for n in (None, rng.integers(1, 9, 400)):
        few, many = summed(rows, n, 5), summed(rows, n, 1 << 22)
        assert all((a == b).all() for a, b in zip(few[0], many[0])) and (few[1] == many[1]).all() and few[1].sum() == (400 if n is None else n.sum())


def test_long_texts_are_scored_in_blocks_alike():
    from docraster.llm.kneser_ney import in_pieces

    text = "  " + prose(random.Random(5), 3000) + " \n"
    part = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
    whole, _ = next(in_pieces(part))
    for block in (64, 1000):
        pieces = list(in_pieces(part, block))
        assert len(pieces) > 3 and (np.concatenate([whole[:2], *(tokens[2:] for tokens, _ in pieces)]) == whole).all()
        assert all((a[-2:] == b[:2]).all() for (a, _), (b, _) in zip(pieces, pieces[1:]))


def near_groups(docs):
    import xxhash

    prints = {}
    for i, t in docs.items():
        w = SPACE.findall(t.translate(LOWER))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in docs:
        for j in docs:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return prints, {i: root(i) for i in docs}


def test_near_duplicates(spark, tables):
    d, docs, _, _ = tables
    prints, groups = near_groups(docs)
    rows = QUERIES["op6_simhash_golay"](spark, d).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (format(prints[i], "016x"), groups[i]) for i in docs}
    assert len(set(groups.values())) < len(docs)


def test_keys_meet_whenever_three_bits_differ():
    from docraster.llm.simhash import Golay, keys_of

    rng, code = np.random.default_rng(1), Golay()
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 4, replace=False):
            y[i] ^= np.uint64(1 << int(b))
    a, b = (set(zip(*(v.tolist() for v in keys_of(z, code)))) for z in (x, y))
    assert {row for row, _ in a & b} == set(range(len(x)))


def test_links_of_a_dense_group_are_a_forest():
    from docraster.llm.simhash import linked

    fp = np.array([1 << i for i in range(40)] + [0], np.uint64)
    x, y = linked(np.zeros(len(fp), np.int64), fp)
    assert len(x) == len(fp) - 1


def contaminated(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(text.translate(LOWER))
    hit, names = set(), set()
    for i, t in items:
        v = word.findall(t.translate(LOWER))
        n = min(13, len(v))
        for k in range(len(v) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit |= set(range(j, j + n))
                    names.add(str(i))
    return len(w), len(hit), sorted(names)


def test_decontamination(spark, tables):
    import hashlib

    d, docs, _, items = tables
    rows = {r["doc_id"]: r for r in QUERIES["op9_decontamination"](spark, d).collect()}
    for i, t in docs.items():
        n, hit, names = contaminated(t, items)
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(names), hit > 0 and 20 * hit >= n)
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert any(r["contaminated"] for r in rows.values())


def test_decontamination_is_native(spark, tables):
    plan = QUERIES["op9_decontamination"](spark, tables[0])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def best_fit(lengths, size=2048):
    bins, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(bins, length)
        left = bins.pop(at) if at < len(bins) else size
        n += left == size
        if left > length:
            bisect.insort(bins, left - length)
    return n


def check_packing(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected = set()
    for i, t in docs.items():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        expected |= {(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected and len(rows) == len(expected)
    assert len({r["sequence_id"] for r in rows}) == best_fit([r["length"] for r in rows])


def test_packing(spark, tables):
    check_packing(QUERIES["op5_best_fit"](spark, tables[0]).collect(), tables[1])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), min_size=1), st.just(60))
def test_plan_is_best_fit_decreasing(histogram, size):
    from docraster.llm.packing import plan

    used, places = collections.defaultdict(list), 0
    for run in plan(histogram, size):
        for k in range(run.n):
            used[run.first + k // run.each].append((run.offset + k % run.each * run.length, run.length))
            places += 1
    assert places == sum(histogram.values())
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert len(used) == best_fit([k for k, n in histogram.items() for _ in range(n)], size)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n\x0b  　abZé'.s1<|>ß中")), max_size=25), min_size=1, max_size=5))
def test_tokens_by_chunks(texts):
    from docraster.llm.packing import tokens_for

    t = tokens_for(vocabulary("byte_bpe_50k.json"))
    ids, bounds = t.ids(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_neighbours(spark, tables):
    rows = QUERIES["op7_adaptive_scan"](spark, tables[0]).collect()
    got = spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in got]), np.array([r["embedding"] for r in got], float)
    hit = n = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        own = {r["vec_id"]: r for r in rows if r["query_id"] == ids[q]}
        assert len(own) == 20 and ids[q] not in own
        hit += len(set(own) & set(ids[np.lexsort((ids, -score))[:20]]))
        n += 20
        assert all(math.isclose(r["score"], score[np.flatnonzero(ids == v)[0]], rel_tol=1e-12, abs_tol=1e-12) for v, r in own.items())
    assert hit / n >= 0.9


def test_copies_of_one_vector_come_by_id():
    from docraster.llm.neighbours import Space, scan

    v = np.tile([[0.6, 0.8]], (3000, 1))
    ids = np.random.default_rng(0).permutation(3000)
    s = Space(2, 1.0, v[:50], 1)
    qi, best, score = scan(ids, v, s.vectors(v), np.array([7]), v[:1], s.queries(v[:1]), np.array([-np.inf]), 20, 1.0)
    assert best.tolist() == [i for i in range(21) if i != 7] and set(score) == {1.0}


@pytest.mark.parametrize("name, label", [("op2_toxicity", 2), ("op3_quality", 1)])
def test_classifiers_on_held_out_rows(spark, tables, name, label):
    d, _, labels, _ = tables
    rows = [r for r in QUERIES[name](spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 30
    assert sum(r["predicted"] == labels[r["doc_id"]][label] for r in rows) / len(rows) >= 0.9


def test_language_on_held_out_rows(spark, tables):
    d, docs, _, _ = tables
    rows = [r for r in QUERIES["op10_language"](spark, d).collect() if r["held_out"] and r["doc_id"] < 240 and len(docs[r["doc_id"]].split()) > 4]
    assert sum(r["lang_pred"] == ["en", "de", "fr"][r["doc_id"] % 3] for r in rows) / len(rows) >= 0.95


def all_segmentations(raw, number, p):
    """Log of the plain sum over all cuts of raw into pieces, last byte first; and of the part before each byte."""
    tail = [0.0] * len(raw) + [0.0]  # log of the sum from each byte on
    for at in range(len(raw) - 1, -1, -1):
        each = [math.log(p[number[raw[at:end]]]) + tail[end] for end in range(at + 1, len(raw) + 1) if raw[at:end] in number]
        most = max(each)
        tail[at] = most + math.log(sum(math.exp(x - most) for x in each))
    return tail


@pytest.fixture(scope="module")
def raw_vocabulary():
    import base64

    return {base64.b64decode(line.split()[0]): i for i, line in enumerate(open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}


TONGUES = ["The quick größe, naïve x2y fox_s!", "हिन्दी में लिखा", "的一是不了人我在有他这为之大来" * 9, "ab" * 150 + " который 있습니다 " + "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft", "e\u0301te\u0301 ...", "12 34", "", None]


def test_forward_sums_all_segmentations(raw_vocabulary):
    import unicodedata

    from docraster.llm.language import Model, Scorer

    rng = np.random.default_rng(0)
    p = np.maximum(rng.random((len(raw_vocabulary), 3)) ** 9, 1e-6)
    p /= p.sum(0)
    scorer = Scorer(Model(vocabulary("byte_bpe_multi_50k.tiktoken"), ["a", "b", "c"], p, np.full(3, -1.0), np.full(3, -2.0)), most=5)
    lang, score, _ = scorer.texts(TONGUES)
    assert lang[5:] == ["und"] * 3 and score[5:].tolist() == [0.0] * 3
    total, size = scorer.totals(TONGUES)
    for i, text in enumerate(TONGUES[:5]):
        letter = [unicodedata.category(c)[0] in "LM" for c in text.lower()]
        words = "".join(c if ok else " " for c, ok in zip(text.lower(), letter)).split()
        plain = [sum(all_segmentations(b" " + w.encode(), raw_vocabulary, p[:, j])[0] for w in words) for j in range(3)]
        assert np.allclose(total[i], plain, rtol=1e-9), text
        assert size[i] == sum(len(w.encode()) + 1 for w in words)
        odds = np.exp(np.array(plain) - max(plain))
        assert lang[i] == "abc"[int(odds.argmax())] and math.isclose(score[i], odds.max() / odds.sum(), rel_tol=1e-6)


def test_long_texts_are_read_in_blocks_that_keep_words_whole():
    from docraster.llm.language import blocks_of, words_of

    for text in TONGUES[:5]:
        for size in (1, 3, 40):
            assert [w for block in blocks_of(text, size) for w in words_of(block)] == words_of(text)


def test_expected_counts(raw_vocabulary):
    """Forward-backward against the plain sums, for short words and for those that need scaling."""
    from docraster.llm.language import Pieces, by_length, expected

    pieces = Pieces(vocabulary("byte_bpe_multi_50k.tiktoken"))
    p = np.random.default_rng(1).random((len(raw_vocabulary), 1)) ** 9 + 1e-6
    p /= p.sum(0)
    words = ["the", "größe", "indivisibility", "ab" * 60, "ab" * 61, "hauptbetriebswerkbauunterbeamtengesellschaft"]
    got, plain = np.zeros(p.shape), np.zeros(len(p))
    for own, matrix, lengths in by_length(words, 2000):
        expected(pieces, list(pieces.edges(matrix, lengths)), lengths, matrix.shape[1], p, np.ones((len(own), 1)), got)
    for w in words:
        raw = b" " + w.encode()
        tail = all_segmentations(raw, raw_vocabulary, p[:, 0])
        back = {piece[::-1]: i for piece, i in raw_vocabulary.items()}
        head = all_segmentations(raw[::-1], back, p[:, 0])[::-1]  # log of the sum up to each byte
        for at in range(len(raw)):
            for end in range(at + 1, len(raw) + 1):
                if (k := raw_vocabulary.get(raw[at:end])) is not None:
                    plain[k] += math.exp(head[at] + math.log(p[k, 0]) + tail[end] - tail[0])
    assert np.allclose(got[:, 0], plain, rtol=1e-7, atol=1e-12)


def test_archives_are_plain_gzip_members_and_broken_ones_are_told():
    from docraster.llm.warc import BrokenArchive, digest, members, page_record, records

    some = [page_record(i, "http://a", "x" * i * 1000, digest(("x" * i * 1000).encode()), None) for i in range(4)]
    raw = b"".join(some)
    assert gzip.decompress(raw).count(b"WARC/1.1") == 4
    assert [r.page("WARC-Record-ID") for r in records(io.BytesIO(raw))] == [0, 1, 2, 3]
    assert len(list(members(io.BytesIO(raw), step=7))) == 4
    with pytest.raises(BrokenArchive):
        list(records(io.BytesIO(raw[:-5])))
    with pytest.raises(BrokenArchive):
        list(records(io.BytesIO(page_record(1, "u", "abc", digest(b"other"), None))))


def test_gradients():
    from docraster.llm import quality, toxicity

    texts = pa.array(["you idiot there", "a fine day to all of you and more words follow here"])
    windows, _, distinct, grams, first = toxicity.encoded(texts)
    net = toxicity.Net.fresh(np.sort(distinct[:6]))
    ids, y = net.known(distinct), np.array([1.0, 0.0], np.float32)
    _, g = net.gradient(windows, ids, grams, first, y)
    for k in ("xf", "hb", "att", "out"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, losses = net.p[k][at], []
        for e in (1e-2, -1e-2):
            net.p[k][at] = old + e
            losses.append(net.gradient(windows, ids, grams, first, y)[0])
        net.p[k][at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-4
    assert quality.passages(texts)[0].shape[1] == quality.FEATURES


def test_pipeline(spark, tables):
    """Stage by stage against plain versions, each on what its predecessor kept."""
    import corpus_pipeline
    from docraster.llm.shared import kept

    d, docs, labels, items = tables
    df = spark.read.parquet(f"{d}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns
        df = kept(out, "step")
        steps[name] = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(steps["language"]) >= 0.97 * len(docs)
    lost = set(steps["language"]) - set(steps["quality"])
    known = [i for i in steps["language"] if i in labels]
    assert sum((i in lost) == (labels[i][1] == 0) for i in known) / len(known) > 0.9
    _, groups = near_groups(steps["quality"])
    assert set(steps["near-duplicates"]) == set(groups.values())
    clean = {i for i, t in steps["near-duplicates"].items() for n, hit, _ in [contaminated(t, items)] if not (hit and 20 * hit >= n)}
    assert set(steps["decontamination"]) == clean
    rows = corpus_pipeline.STAGES[-1][1](spark, df, d).collect()
    check_packing(rows, steps["decontamination"])
    whole = corpus_pipeline.run(spark, d).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows}
