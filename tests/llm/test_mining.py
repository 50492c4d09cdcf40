"""Collocations, SimHash and spelling variants against brute force, and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexbind.llm import collocations, simhash, spelling

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def with_clashes(df):
    for c in ("range", "words", "n", "bits", "word", "component", "shard", "phrase"):
        df = df.withColumn(c, F.lit(1))
    return df


# 11 --------------------------------------------------------------------------


def plain_collocations(rows, top=2000):
    out = []
    by_lang = defaultdict(list)
    for _, text, lang in rows:
        by_lang["und" if lang is None else lang] += [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text))]
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(a for g, a in f.items() if len(g) == 1)
        found = {}
        for g, a in f.items():
            if len(g) > 1 and a >= 10:
                score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found[g] = (score, a, f[g[:k]], f[g[k:]])
        kept = {g for g in found if not any(len(h) > len(g) and g in (h[:2], h[1:]) and 100 * f[h] >= 50 * f[g] for h in found)}
        best = sorted(kept, key=lambda g: (-found[g][0], -found[g][1], " ".join(g).encode()))[:top]
        out += [(lang, r + 1, " ".join(g), found[g][1], found[g][2], found[g][3], n, found[g][0]) for r, g in enumerate(best)]
    return sorted(out)


def phrases(seed, n_docs=60):
    r = random.Random(seed)
    common = ["new york city", "of the", "Hot dog", "hot DOG stand", "a b", "ß é", "x\x01y z", "the the the the"]
    rows = []
    for i in range(n_docs):
        words = [r.choice(common) if r.random() < 0.5 else r.choice(["lorem", "ipsum", "the", "of", "city", "dog", f"w{r.randrange(40)}"]) for _ in range(r.randrange(0, 60))]
        text = "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "! ", "\x0b"]) for w in words)
        rows.append((i, text, r.choice(["en", "de", None, "und"])))
    return rows + [(900, None, "en"), (901, "", "fr"), (902, " ,. ", "fr"), (None, "hot dog " * 30, "en"), (903, "hot dog " * 30, "en"), (903, "hot dog " * 30, "en"), (904, "z" * 5000, None)]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    """Also with shards, blocks, slices and ranges of a few words, so that phrases
    cross shards and paths cross ranges."""
    if small:
        for name, value in (("SHARD_WORDS", 40), ("SLICE", 64), ("BLOCK_NODES", 16), ("MARK", 4), ("RANGE_NODES", 60)):
            monkeypatch.setattr(collocations, name, value)
    rows = phrases(3)
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert got == plain_collocations(rows)
    assert len(got) > 10
    few = sorted(tuple(r) for r in collocations.collocations(docs, 3).collect())
    assert few == plain_collocations(rows, 3)


def test_collocations_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "..", "en")], SCHEMA)).collect() == []


def test_collocations_of_large_counts(spark):
    """Products beyond 64 bits: floor(1e6 * a * a / (l * r)) is exact."""
    nodes = [("en", "a", "", "", 3_000_000_007), ("en", "b", "", "", 2_999_999_999), ("en", "a", "b", "", 2_999_999_998)]
    df = spark.createDataFrame([(*n, 3_000_000_007, None) for n in nodes], "lang string, w1 string, w2 string, w3 string, a long, up1 long, up2 long")
    row = collocations.candidates(df).collect()[0]
    assert row.score == 1_000_000 * 2_999_999_998**2 // (3_000_000_007 * 2_999_999_999)


def test_trie_blocks():
    words = [b"a", b"bb", b"c", b"\xc3\xa9"]
    base = len(words) + 1
    nodes = np.array(sorted({(r1 * base + r2) * base + r3 for r1 in (1, 3) for r2 in (0, 4) for r3 in (0, 1) if r2 or not r3}), np.int64)
    counts = np.arange(1, len(nodes) + 1) * 10**10
    held, keys, read = collocations.read_block(collocations.block(words, nodes, counts, base))
    assert held == [b"a", b"c", b"\xc3\xa9"] and (read == counts).all()
    back = [[b"", *held][d] for ds in zip(*collocations.digits(keys, len(held) + 1)) for d in ds]
    assert back == [[b"", *words][d] for ds in zip(*collocations.digits(nodes, base)) for d in ds]


# 12 --------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least doc_id that each row reaches, by comparing all distinct fingerprints."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, f, least.get(find(f))) for d, f in prints]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def test_simhash_documents(spark):
    r = random.Random(5)
    base = [r.choice(["lorem", "ipsum", "Dolor", "été", "sit", "amet"]) + str(r.randrange(30)) for _ in range(400)]
    rows = [(i, " ".join([*base[: 5 * i], "new", *base[5 * i :]]), "en") for i in range(40)]
    rows += [(100 + i, " ".join(r.choices(base, k=r.randrange(1, 50))), "en") for i in range(40)]
    rows += [(200, None, None), (201, "", None), (202, "one", None), (203, "ONE", None), (204, "one two", None), (None, " ".join(base), None), (205, " ".join(base), None), (205, "other text here now", None), (None, "alone with no id", None), (206, "word " * 100_000, None), (207, " \t\n", None)]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert order(got) == order(plain_components([(d, plain_fingerprint(t)) for d, t, _ in rows]))
    assert all(len(r.fingerprint) == 16 for r in simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_simhash_ball_links(spark):
    """Every pair of fingerprints within two bits is found, crowded centres included."""
    r = random.Random(6)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        prints |= {centre, *(centre ^ (1 << k) for k in range(64) if r.random() < 0.6)}
        prints |= {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(20)}
    prints |= {0, 2**64 - 1, 1 << 63, 3}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    got = {frozenset(p) for p in simhash.near_pairs(spark.createDataFrame([(s,) for s in signed], "bits long")).collect()}
    want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


# 13 --------------------------------------------------------------------------


def plain_spelling(rows):
    n = Counter()
    for d, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and distance(w, v) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def spelled(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abéÿn", k=r.randrange(5, 12))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "château", "chateau", "STRASSE", "straße×", "abcabc", "abcabcabc"]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(30):
            w = words[min(int(r.expovariate(0.15)), len(words) - 1)]
            if r.random() < 0.15:
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abn") + w[k:], w[:k] + r.choice("abn") + w[k + 1 :]])
            parts.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i if i % 50 else None, r.choice([" ", "-", "1"]).join(parts), "en"))
    chain = " ".join(["abcdef"] * 140 + ["abcdeh"] * 27 + ["abcdhh"] * 5)
    return [*rows, (5, chain, "en"), (1, None, None), (2, "", None), (3, "lóngest" * 3000, None), (3, "lóngest" * 3000, None)]


@pytest.mark.parametrize("small", [False, True])
def test_spelling(spark, monkeypatch, small):
    """Also with shards of a few words, so that groups are split and pooled."""
    if small:
        monkeypatch.setattr(spelling, "SHARD_WORDS", 4)
        monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = spelled(7)
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(4)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs).collect())
    want = plain_spelling(rows)
    assert got == want
    assert sum(1 for w in want if w[1]) > 10 and any(w[1] and w[1] != w[2] for w in want)


def test_spelling_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []


def test_one_edit_and_automaton():
    r = random.Random(9)
    words = sorted({"".join(r.choices("ab", k=r.randrange(6, 10))) for _ in range(150)})
    machine = spelling.Automaton([(s, w) for w in words for s in ("left", "right")])
    for w in words:
        assert machine.near(w) == {v for v in words if spelling.one_edit(w, v)}
        others = {w[:k] + x + w[k:] for k in range(len(w) + 1) for x in "ab"} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + x + w[k + 1 :] for k in range(len(w)) for x in "ab"}
        assert {v for v in words if spelling.one_edit(w, v)} == set(words) & others - {w}


def test_factors_come_from_all_documents(spark):
    """The product that is factored holds every passage of every document, rows without an id included."""
    import numpy as np

    from lexbind.llm import latent

    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words + ["out"], 150)) for _ in range(2500)]
    docs = spark.createDataFrame([(None if k % 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    items = latent.Items([(1, words[:40]), (2, words[30:])])
    items.weigh(*latent.document_frequencies(docs, items))
    assert items.documents == 2500
    want = np.zeros((60, 60))
    for t in texts:
        codes = [items.index.to_pylist().index(w) if w != "out" else -1 for w in t.split()]
        for at in range(0, len(codes), 64):
            row = np.zeros(60)
            for c in codes[at : at + 64]:
                if c >= 0:
                    row[c] += items.weight[c]
            want += np.outer(row, row) / (row @ row)
    got = latent._products(docs, items, np.eye(60))
    assert abs(got - want).max() < 0.02 * abs(want).max() and abs(np.trace(got) - np.trace(want)) < 0.02 * np.trace(want)
    vectors = latent.factors(docs, items)
    assert vectors.shape == (60, 60) and np.abs(vectors.T @ vectors - np.eye(60)).max() < 1e-3
