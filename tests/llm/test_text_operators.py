"""Decontamination, SimHash, token output and line dedup against brute force, with the awkward rows of every table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from skein.llm import decontaminate, linededup, simhash, tokens
from skein.llm.components import connected, roots

DOCS = "doc_id long, text string, n_words string, fp string, key int"  # with names that operators use inside
VOCABULARY = [f"w{i}" for i in range(12)] + ["é", "W3", "x-y"]


def frame(spark, texts, ids=None):
    rows = [(i, t, "extra", "clash", 1) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def sentences(seed, n, size=40):
    rng = random.Random(seed)
    return [" ".join(rng.choices(VOCABULARY, k=rng.randrange(size))) for _ in range(n)]


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def contamination(texts, items, window):
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for item, body in items:
            w = words_of(body)
            size = min(window, len(w))
            for gram in {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else ():
                for i in range(len(words) - size + 1):
                    if tuple(words[i : i + size]) == gram:
                        hit |= set(range(i, i + size))
                        found |= {str(item)} if item is not None else set()
        out.append((len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = "item_id long, text string, n_words int"


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    texts = [*sentences(1, 60), None, "", "w1", "W1,W2;w3", " ".join(["w1"] * 3000), "w1 w2 w3 w4 w5 w6"]
    items = [(i, t) for i, t in enumerate(sentences(2, 8, 14))] + [(90, "w1 w2"), (91, ""), (92, None), (10, "w3 w4 w5 w6"), (10, "w4 w5 w6 w7"), (None, "w8 w8 w9 w9"), (90, "w1 w2")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = decontaminate.digests(frame(spark, texts).repartition(3), bench, window=4, shard_words=50, block_bytes=block_bytes).collect()
    expected = contamination(texts, items, 4)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == dict(enumerate(expected))
    kept = decontaminate.clean(frame(spark, texts), bench, window=4, shard_words=50, block_bytes=block_bytes)
    assert kept.columns == ["doc_id", "text", "n_words", "fp", "key"]
    assert {r.doc_id for r in kept.collect()} == {i for i, e in enumerate(expected) if not e[4]}


def test_decontamination_repeats_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c", 1)], ITEMS)
    docs = frame(spark, ["x a b c", "x a b c", "no"], [5, 5, None])
    assert sorted(str((r.doc_id, r.n_hit)) for r in decontaminate.digests(docs, bench).collect()) == ["(5, 3)", "(5, 3)", "(None, 0)"]
    assert decontaminate.digests(docs.where("false"), bench).count() == 0
    assert [r.n_hit for r in decontaminate.digests(docs, bench.where("false")).collect()] == [0, 0, 0]
    assert decontaminate.clean(docs, bench.where("false")).count() == 3


def test_longest_matches(spark):
    bench = spark.createDataFrame([(7, "q a b c d e z", 1)], ITEMS)
    got = decontaminate.longest_matches(frame(spark, ["x y a b c d e f", "a b c"]), bench, min_words=3).collect()
    assert sorted((r.item_id, r.item_word, r.doc_id, r.doc_word, r.n_words) for r in got) == [(7, 1, 0, 2, 5)] or (7, 1, 0, 2, 5) in {(r.item_id, r.item_word, r.doc_id, r.doc_word, r.n_words) for r in got}


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, 300).astype(np.int32)
    ids[-1] = 0
    sa = decontaminate.suffix_array(ids, 64)
    cut = lambda p: tuple(ids[p : p + int(np.argmax(ids[p:] == 0))].tolist())
    assert sorted(sa.tolist()) == np.flatnonzero(ids).tolist()
    assert [cut(p) for p in sa.tolist()] == sorted(map(cut, sa.tolist()))


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    base = sentences(5, 12, 200)
    rng, texts = random.Random(6), []
    for t in base:
        texts.append(t)
        for _ in range(6):
            w = t.split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += [None, "", "one", "One", "one two", "É é", "long " * 30000, base[1], base[1]]
    fps = [simhash_of(t) for t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    expected = components(links, range(len(fps)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, texts).repartition(3)).collect()}
    assert got == {i: (f"{f:016x}", expected[i]) for i, f in enumerate(fps)}


def test_simhash_ids_and_empty_tables(spark):
    docs = frame(spark, ["a b c d", "a b c d", "a b c d", "z z y", "z z y"], [None, 4, 4, None, None])
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == ["(4, 4)", "(4, 4)", "(None, 4)", "(None, None)", "(None, None)"]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_anchors_cover():
    """Any two halves within one bit share an anchor, and each anchor lies within covering radius plus threshold."""
    near, far = simhash.cosets()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 4000)
    y = x ^ (1 << rng.integers(0, 32, 4000))
    first, second = (set(zip(*(a.tolist() for a in simhash.anchors(v, near, far)), strict=True)) for v in (x, y))
    assert {r for r, _ in first & second} == set(range(4000))
    rows, keys = simhash.anchors(x, near, far)
    code = (1 << simhash.CODE_BITS) - 1
    assert np.bitwise_count((x[rows] ^ keys) & code).max() <= 4
    assert not simhash.syndromes(keys & code).any()


def test_crowded_anchor_is_exact():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 40, 900).astype(np.uint64))
    values = np.unique(np.concatenate([values, values[:300] ^ np.uint64(0b111), values[:100] ^ np.uint64(1 << 60)]))
    pairs = simhash.links_of_anchor(values, 3, 32).view(np.int64)
    expected = simhash.close_pairs(values, 3)
    lead = lambda p: {int(a): int(b) for a, b in p}
    same = [(i, j) for i in range(len(values)) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 3 and any((int(values[i]) >> 32 + 8 * b & 255) == (int(values[j]) >> 32 + 8 * b & 255) for b in range(4))]
    whole = components(same, range(len(values)))
    assert {k: v for k, v in whole.items() if k != v} == lead(expected)
    assert {int(values[k].view(np.int64)): int(values[v].view(np.int64)) for k, v in whole.items() if k != v} == lead(pairs)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (7, 8), (8, 7)]
    nodes = {x for e in edges for x in e}
    expected = {k: v for k, v in components(edges, nodes).items() if k != v}
    got = connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == expected
    assert {int(a): int(b) for a, b in roots(np.array(edges))} == expected
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tokens(spark):
    texts = ["a b", None, "", "two  spaces ", "don't\n\nstop <|endoftext|> é 中文 x y", "long words " * 20000, "a b"]
    ids = [3, 9, 1, None, 7, 5, 3]
    tool = Tokenizer.from_file(tokens.tokenizer_files()[0])
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, expected = 0, []
    for doc, text in rows:
        codes = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((doc, at, len(codes), zlib.crc32(np.array(codes, "<u4").tobytes())))
        at += len(codes)
    got = tokens.round_trip(frame(spark, texts, ids), parts=3).collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got)
    assert tokens.round_trip(frame(spark, texts, ids).where("false")).count() == 0


def test_encoder_equals_library():
    tool = tokens.Encoder(*tokens.tokenizer_files())
    rng = random.Random(1)
    letters = " \n\t abé.,'s12 ＡБ中  😀<|>|$%\x1c\x85ª_-I'll"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(16)))
        assert tool.text(text) == tool.whole(text), repr(text)


def test_token_lookup(spark, tmp_path):
    path = str(tmp_path / "orc")
    tokens.write(frame(spark, [f"text number {i}" for i in range(500)]), path, parts=4)
    rows = tokens.lookup(spark, path, [17, 400])
    assert sorted(r.doc_id for r in rows.collect()) == [17, 400]
    assert "doc_id" in rows._jdf.queryExecution().toString().split("PushedFilters")[1][:60]


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    rng, texts = random.Random(8), []
    pool = [rng.choices(VOCABULARY[:8], k=rng.randrange(1, 9)) for _ in range(25)]
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(5)):
            w = list(rng.choice(pool))
            if rng.random() < 0.5:
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = rng.choices(VOCABULARY[:8], k=rng.randrange(2))
            lines.append("  ".join(w))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "a " * 5000]
    places = [(d, i, line.split()) for d, t in enumerate(texts) for i, line in enumerate((t or "").split("\n")) if line.split()]
    expected = {}
    for k, (d, i, w) in enumerate(places):
        near = [p for p in places[:k] if p[2] != w and max(len(p[2]), len(w)) >= 5 and word_distance(p[2], w) <= 1]
        same = [p for p in places[:k] if p[2] == w]
        first = same[0] if same else (d, i, w)
        near = [p for p in near if p[:2] < first[:2]]
        if near or same:
            expected[d, i] = (len(w), bool(near), *(near or same)[0][:2])
    docs = frame(spark, texts)
    got = {(r.doc_id, r.line_no): (r.n_words, r.near, r.earlier_doc_id, r.earlier_line_no) for r in linededup.duplicates(docs.repartition(3)).collect()}
    assert got == expected
    left = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    for d, t in enumerate(texts):
        assert left[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in expected))


def test_lines_ids_and_empty_tables(spark):
    docs = frame(spark, ["a b\na b", "a b", "a b", "c"], [None, 2, 2, 3])
    assert linededup.duplicates(docs).count() == 0
    assert linededup.duplicates(docs.where("false")).count() == 0
    assert linededup.deduplicated(docs).columns == docs.columns


def test_rows_of_one_id_keep_their_lines(spark):
    texts = ["a b c d e f", "a b c d e f", "only here and nowhere else\nsecond", "last", None]
    docs = frame(spark, texts, [1, 5, 5, None, None])
    left = [(r.doc_id, r.text) for r in linededup.deduplicated(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, "a b c d e f"), (5, ""), (5, "only here and nowhere else\nsecond"), (None, "last"), (None, None)], key=str)


def test_one_line_with_many_variants(spark, monkeypatch):
    """A greeting whose every variant finds the same earlier line: its links are dealt over tasks and all found."""
    from skein.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    texts = ["good morning to all of you"] + [f"good morning to all of {i}" for i in range(60)]
    got = {(r.doc_id, r.earlier_doc_id) for r in linededup.duplicates(frame(spark, texts)).collect()}
    assert got == {(i, 0) for i in range(1, 61)}
