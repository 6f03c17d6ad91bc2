from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftwell.llm.common import table
from driftwell.llm.components import connected_components
from driftwell.llm.simhash import BKTree, bit_counts, fingerprint_links, keep_first, near_duplicates, similar_documents, similar_radius, text_fingerprint, widened

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_classes(prints, radius=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_tree_finds_all_within_radius():
    rnd = random.Random(1)
    values = [rnd.getrandbits(64) for _ in range(20)]
    values += [v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in values for _ in range(20)]
    tree = BKTree()
    at = {tree.add(v): v for v in values}
    for v in values:
        assert {at[n] for n in tree.near(v, 3)} == {w for w in values if (v ^ w).bit_count() <= 3}


def test_links_keep_classes_with_small_trees(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(5)]
    values = list({b ^ sum(1 << x for x in rnd.sample(range(40), rnd.randrange(5))) for b in base for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "_f long")
    want = {}
    for v, c in zip(signed, slow_classes(values)):
        want.setdefault(c, set()).add(v)
    for tree in (8, 4096):
        got = {}
        for r in connected_components(fingerprint_links(df, tree=tree)).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_documents_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.orderBy("doc_id").collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    classes = slow_classes(prints)
    want = sorted((r.doc_id, f"{f:016x}", rows[c].doc_id) for r, f, c in zip(rows, prints, classes))
    assert sorted(tuple(r)[:3] for r in near_duplicates(docs).collect()) == want
    kept = sorted(r.doc_id for r in keep_first(docs).collect())
    assert kept == sorted({c for _, _, c in want})


def test_odd_rows(spark):
    long = "wort " * 60_000
    rows = [(4, None), (2, ""), (9, " \t\n"), (5, long), (6, long + "x"), (7, "A B"), (8, "a b"), (8, "a b"), (None, "a b"), (None, "only here"), (None, "only here"), (3, "é é ü")]
    docs = spark.createDataFrame([(i, t, None, "s", 1, "clash") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(4, 2), (2, 2), (9, 2), (5, 5), (6, 5), (7, 7), (8, 7), (8, 7), (None, 7), (None, None), (None, None), (3, 3)], key=str)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 5, 7, None]
    assert near_duplicates(docs.filter(F.lit(False))).count() == 0
    assert keep_first(docs.filter(F.lit(False))).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}


def test_bit_counts():
    rng = np.random.default_rng(1)
    for n in (1, 254, 255, 256, 20_000):
        h = widened(rng.integers(0, 2**63, n, np.uint64), 3)
        assert bit_counts(h).tolist() == np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little").sum(axis=0, dtype=int).tolist()


def test_bits_tell_similarity():
    rnd = random.Random(3)
    for copies, want in ((0.9, True), (0.6, False)):
        near = 0
        for _ in range(40):
            a = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
            shared = round(2 * copies / (1 + copies) * 400)
            b = a[:shared] + [f"x{rnd.randrange(10**6)}" for _ in range(400 - shared)]
            bits = [int.from_bytes(text_fingerprint(" ".join(t), 1, 8), "little") for t in (a, b)]
            near += (bits[0] ^ bits[1]).bit_count() <= similar_radius(0.8, 512)
        assert near >= 38 if want else near <= 2


def test_similar_documents(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(5000)}"
    texts, group = {}, {}
    for g in range(40):
        base = [word() for _ in range(300)]
        for c in range(6):
            copy = list(base)
            for _ in range(c):
                copy[rnd.randrange(300)] = word()  # at most 5 of 300 words: similarity over 0.84
            texts[10 * g + c], group[10 * g + c] = " ".join(copy), 10 * g
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in similar_documents(docs).collect()}
    assert all(group[i] == group[c] for i, c in got.items())
    assert sum(got[i] == group[i] for i in got) >= 0.99 * len(got)
    kept = keep_first(docs, similarity=0.8, shingle=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    odd = docs.filter("doc_id < 2").unionByName(spark.createDataFrame([(None, None, None, None, None, None), (None, "", None, None, None, None), (7000, "only", None, None, None, None)], SCHEMA))
    assert sorted((str(r.doc_id) for r in keep_first(odd, similarity=0.8, shingle=5).collect())) == ["0", "7000", "None"]
    assert keep_first(docs.limit(0), similarity=0.8).count() == 0


def test_similar_documents_against_brute_force_with_repeated_lines(spark):
    rnd = random.Random(12)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line, texts = words(10), []
    for n, repeats in ((200, 20), (250, 30), (60, 8)):
        texts += [words(n) + line * repeats for _ in range(12)]
    for repeats in (5, 15, 30):
        for _ in range(4):
            own, its = words(300), words(10)
            texts += [own + its, own + its * repeats]
    # A chain of steps of about 0.85, ends far apart, and a group just under the similarity.
    step = words(300)
    for _ in range(8):
        step = step[24:] + words(24)
        texts.append(step)
    base = words(300)
    texts += [base[:265] + words(35) for _ in range(10)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = {i: root(i) for i in range(len(texts))}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1, "clash") for i, t in enumerate(texts)], SCHEMA)
    for tree in (8, 4096):
        assert {r.doc_id: r.component_id for r in similar_documents(docs, tree=tree).collect()} == want
    assert sorted(r.doc_id for r in keep_first(docs, similarity=0.8, shingle=5).collect()) == sorted(set(want.values()))
