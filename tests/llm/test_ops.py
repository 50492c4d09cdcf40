"""The ten operators on small inputs: results against brute force, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexbind.llm import latent, neardup, pieces, pii, quality, ring, simple8b, suffixtree, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["an", "to", "re", "li", "mo", "ka", "shu", "den", "por", "vi"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    out = [(i, prose(i, 30 + i), "en", "s") for i in range(2, 30)]
    out += [(40, base, "en", "s"), (41, base, "en", "s"), (42, near, "en", "s"), (43, None, "en", None), (44, "", None, "s"), (45, "one two", "en", "s"), (46, "One TWO", "en", "s")]
    out += [(None, base, "en", "s"), (47, prose(9, 60), "en", "s"), (47, prose(9, 60), "en", "s"), (48, "x" * 30000, "en", "s"), (49, "mail me: a.b@c.example.org or +1 (555) 010-2030", "en", "s")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["key", "tag", "node", "kept", "n", "_text", "block"]
    return spark.createDataFrame([(*r, *range(len(clash))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in clash))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# 1 ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 59, 61, 1023, 1025, 3000])
@pytest.mark.parametrize("top", [2, 50_000, 2**40, 2**63])
def test_simple8b_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    firsts, words = simple8b.encode_words(ids)
    assert (simple8b.decode_words(words, firsts, n) == ids).all()
    image = simple8b.pack_file([7], [n], ids, 3)
    assert (simple8b.unpack_file(image)[2] == ids).all()
    if n > 1024:
        assert (simple8b.decode_block(image, 1) == ids[1024:2048]).all()


def test_simple8b_escapes():
    ids = np.full(2500, 2**64 - 1, np.uint64)
    firsts, words = simple8b.encode_words(ids)
    assert (simple8b.decode_words(words, firsts, 2500) == ids).all()


def test_ids_equal_the_library(spark, docs, rows, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    files = simple8b.write_ids(docs, path)
    got = simple8b.read_ids(files, with_ids=True).collect()
    want = sorted(((r[0], whole.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted([(r.doc_id, list(r.ids)) for r in got], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert simple8b.export_files(files, str(tmp_path))


def test_odd_texts_equal_the_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    for t in ["Hello's I'LL <|endoftext|> x", "ÀÉ ß İi ﬁ ΑΣ '' !'s a'd'll 12ab3 \x1c \x85 a\xa0b ª²½", "日本 ёж", "a\x0bb\x0cc\td", "é x"]:
        assert simple8b.encode_texts(pa.array([t, "plain"]), path)[0].tolist()[: -len(whole.encode("plain").ids)] == whole.encode(t, add_special_tokens=False).ids


def test_token_cuts_by_character():
    """The cut into pieces equals the library on whole texts: every character
    below U+0250 and some beyond, alone, doubled and beside letters, digits and marks."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = [*range(1, 0x250), 0x2028, 0x2019, 0x3000, 0x4E2D, 0x1F600, 0x0301, 0x0130]
    texts = [f"ab{c}cd {c} {c}{c} 12{c}3 '{c}s {c}. A{c}{d}b" for c in map(chr, odd) for d in "a1.' \n\u00e9"]
    ids, lengths = simple8b.encode_texts(pa.array(texts), path)
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


# 2 ---------------------------------------------------------------------------


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_language_model(docs, rows):
    blocks = suffixtree.count_blocks(docs)
    out = suffixtree.score_blocks(blocks, suffixtree.fit_tree(blocks)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r[1])), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    model = brute_tree([r[1] for r in rows if not held(r[0])])
    want = sorted((str(r[0]), round(brute_score(model, r[1]), 6)) for r in rows)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in out) == want


def test_language_model_small_chunks(spark):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(20)], "doc_id long, text string").repartition(4)
    blocks = suffixtree.count_blocks(docs)
    tree = suffixtree.fit_tree(blocks)
    whole, cut = (sorted(suffixtree.score_blocks(blocks, tree, n).collect()) for n in (10**6, 2))
    assert whole == cut and len(cut) == 20


def symbols(text):
    """(context, symbol, word so far) of every symbol of a text."""
    tail, out = b"\t", []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()):
        for j, s in enumerate(w + b" "):
            out.append(((tail + b" " + w[:j])[-4:] if j < 3 else b" " + w[:j], s, w[:j]))
        tail = w[-3:]
    out.append(((tail + b" ")[-4:], 10, b""))
    return out


def states_of(context):
    """The contexts that a place counts for, shortest first."""
    out = [context[len(context) - k :] for k in range(1, min(4, len(context)) + 1)]
    return out + ([context] if 5 <= len(context) else [])


def brute_tree(texts):
    """(order-0 probabilities, counts of contexts, retained contexts), by dictionaries."""
    order0, counts = Counter(), {}
    for t in texts:
        for context, s, _ in symbols(t):
            order0[s] += 1
            for c in states_of(context):
                counts.setdefault(c, Counter())[s] += 1
    counts = {c: n for c, n in counts.items() if sum(n.values()) >= 2}
    root = {s: (order0[s] + 0.5) / (sum(order0.values()) + 128) for s in range(256)}

    def grows(c, states):
        n = counts[c]
        total = sum(n.values())
        kl = sum(k / total * math.log(k / total / chain((root, counts), states, s)) for s, k in n.items())
        return kl >= suffixtree.MIN_KL and kl * total >= suffixtree.DIVERGENCE + len(n)

    kept = {c for c in counts if len(c) <= 6 and grows(c, [x for x in states_of(c) if x != c and x in counts])}
    for k in (6, 5, 4, 3, 2):
        kept |= {c[-min(k - 1, 4) :] for c in kept if len(c) == k and c[-min(k - 1, 4) :] in counts}
    both = (root, counts)
    kept |= {c for c in counts if len(c) > 6 and grows(c, [x for x in states_of(c[-4:]) if x in kept])}
    return both, kept


def chain(model, states, s):
    p, counts = model[0][s], model[1]
    for c in states:
        n = counts[c]
        p = (n[s] + len(n) * p) / (sum(n.values()) + len(n))
    return p


def brute_score(model, text):
    both, kept = model
    return sum(math.log10(chain(both, [c for c in states_of(context) if c in kept], s)) for context, s, _ in symbols(text))


def test_tree_probabilities_sum_to_one():
    windows, word, _ = suffixtree.inner_windows(pa.array(["abcabc", "abcabd", "xyzzy"], pa.large_string()))
    counts = Counter(windows.tolist())
    entries, contexts = {}, {}
    for k in range(suffixtree.WINDOW):
        grams, ctx = Counter(), {}
        for w, n in counts.items():
            if k == 0 or w >> (8 * k) and (k <= suffixtree.DEPTH or w >> (8 * k) < 256):
                key = w & ((1 << 8 * (k + 1)) - 1)
                grams[key] += n
                ctx.setdefault(key >> 8, Counter())[key & 255] += n
        entries[k] = (np.array(sorted(grams), np.uint64), np.array([grams[g] for g in sorted(grams)], float))
        if k:
            keys = sorted(ctx)
            contexts[k] = (np.array(keys, np.uint64), np.array([sum(ctx[x].values()) for x in keys], float), np.array([len(ctx[x]) for x in keys], float))
    tree = suffixtree.build_tree(sum(counts.values()), contexts, entries)
    for ctx in (0x61, 0x6162, 0x616263, 0x20616263):
        p = tree.probabilities(np.array([(ctx << 8) | s for s in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9


def test_language_model_empty(empty):
    blocks = suffixtree.count_blocks(empty)
    assert suffixtree.score_blocks(blocks, suffixtree.fit_tree(blocks)).count() == 0


# 3 ---------------------------------------------------------------------------


def brute_quality(t):
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


@pytest.mark.parametrize("t", ["", "\n\n", "a\na\n\na", "\x1c a\x1cb \xa0\n\xa0\n\xa0", "a b a b a b a", "x y z w x y z", "#* |", prose(3, 200) + "\n" + prose(3, 200)])
def test_quality_figures(t):
    assert quality.base_figures(t) == brute_quality(t)


def test_quality_model(spark, docs):
    good = [(1000 + i, prose(i, 80), 1) for i in range(150)]
    bad = [(3000 + i, " ".join(w + "***" for w in prose(i, 80).split()), 0) for i in range(60)]
    both = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (5000, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score(both, quality.fit(both, labels)).collect()}
    assert sum(out[i].kept for i, _, _ in good) >= 145 and sum(out[i].kept for i, _, _ in bad) <= 3
    assert out[5000].n_words == 0 and out[5000].base_failed and not out[5000].kept
    none = quality.score(docs, quality.fit(docs, labels.limit(0))).collect()
    assert all(r.kept == (not r.base_failed) for r in none)


def test_quality_keeps_columns(docs, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = quality.score(docs, quality.fit(docs, labels), tuple(c for c in others if c not in ("kept",)))
    assert scored.count() == docs.count()
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


# 4 ---------------------------------------------------------------------------


def test_toxicity_held_out(spark, empty):
    r = random.Random(5)
    data = []
    for i in range(900):
        words = prose(i, 60).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zorgling", "blathek", "blatheks", "crumpot"]))
        data.append((i, " ".join(words) + ".", int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None), (9000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = {row.doc_id: row for row in toxicity.score(docs, model).collect()}
    truth = {i: y for i, _, y in data}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and out[None].held_out
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert out[9000].predicted == 0 and 0 <= out[9000].score <= 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == docs.count()


def test_terms_beside_others_are_learned():
    rows = []
    for i in range(300):
        toxic = i % 5 == 0
        # Every toxic row has the first term; the others only occur beside it.
        more = ["zorgling"] + ["crumpot"] * (i % 2) + ["blathek", "blatheks"][: i % 3] if toxic else []
        rows.append((" ".join([prose(i, 40), *more]) + ".", int(toxic)))
    terms = toxicity.learn_terms(rows)
    assert {"zorgling", "crumpot", "blathek", "blatheks"} == {t for t in terms if t[0] in "zb" or t.startswith("cr")}
    grammar = toxicity.Grammar(terms)
    assert all(grammar.evidence(f"a {w} here")[0] > 0 for w in ("zorgling", "crumpot", "blathek", "blatheks"))


def test_grammar_contexts():
    g = toxicity.Grammar({"blathek": (toxicity.INSULT, 8.0)})
    plain, aimed, negated, told = (g.evidence(t) for t in ("a blathek here", "you blathek", "not a blathek", "he said blathek"))
    assert plain[0] > 0 and aimed[1] > 0 and negated[2] > 0 and told[3] > 0
    assert negated[4] < plain[4] < aimed[4]
    assert g.evidence("xblathek")[5] == 0 and g.evidence("")[5] == 0


def brute_clause(words, terms):
    """Terms of a clause by looking at each one's surroundings."""
    out, targets = [], [k for k, w in enumerate(words) if w in toxicity.CUES[toxicity.TARGET]]
    waiting = []
    for k, w in enumerate(words):
        hit = next((terms[w[:n]] for n in range(len(w), 0, -1) if w[:n] in terms), None)
        if hit is None:
            if w in toxicity.CUES[toxicity.TARGET] and waiting:
                t = max(waiting, key=lambda x: (x[1], -x[3]))
                out.append((k, t[0], t[1], "targeted" if t[2] == "plain" else t[2]))
                waiting = []
            continue
        before = words[:k]
        path = "negated" if any(x in toxicity.CUES[toxicity.NEGATION] for x in before[-3:]) else "reported" if any(x in toxicity.CUES[toxicity.REPORT] for x in before) else "plain"
        seen = any(t < k for t in targets)
        if hit[0] == toxicity.THREAT and not seen:
            waiting.append((hit[0], hit[1], path, k))
            continue
        out.append((k, hit[0], hit[1], "targeted" if seen and path == "plain" else path))
    return [x[1:] for x in out]


def test_grammar_composition():
    terms = {"blathek": (toxicity.INSULT, 5.0), "zorgl": (toxicity.INSULT, 7.0), "grumph": (toxicity.THREAT, 3.0)}
    g = toxicity.Grammar(terms)
    both = terms | {t: (toxicity.THREAT, 2.0) for t in toxicity.CUES[toxicity.THREAT]}
    r = random.Random(6)
    pool = ["blathek", "blatheks", "zorgling", "grumph", "kill", "you", "your", "not", "never", "said", "claims", "and", "house", "tree"]
    for _ in range(3000):
        words = r.choices(pool, k=r.randint(0, 9))
        assert [(x.kind, x.weight, x.path) for x in g.clause(words)] == brute_clause(words, both), words
    for text in ("I will kill you", "kill you", "you, kill"):
        assert g.evidence(text)[1] > 0 and g.evidence(text)[0] == 0
    assert not g.evidence("they kill time. You wait").any()


def test_learned_threats_and_linear_time():
    import time

    rows = [(f"{prose(i, 30)} i will grumph you. {prose(i + 99, 9)} blathek {prose(i, 9)}", 1) for i in range(12)] + [(prose(1000 + i, 50), 0) for i in range(200)]
    terms = toxicity.learn_terms(rows)
    assert terms["grumph"][0] == toxicity.THREAT and terms["blathek"][0] == toxicity.INSULT
    g, took = toxicity.Grammar(terms), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        g.evidence("a blathek b? " * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_toxicity_edge_cases(spark):
    rows = [(1, None), (1, "you blathek"), (None, ""), (2, "word " * 100_000), (3, "you blathek"), (3, "you blathek")]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, score int, held_out int, toxic int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, 0, 0)], "doc_id long, toxic int, text int")
    out = toxicity.score(df, ({"blathek": (toxicity.INSULT, 5.0)}, np.array([1.0] * 6 + [-2]))).collect()
    assert len(out) == 6 and out[4].score == out[5].score == out[1].score > out[0].score == out[2].score == out[3].score
    assert toxicity.score(df, toxicity.fit(df, labels)).count() == 6


# 5 ---------------------------------------------------------------------------


def shingles(t):
    w = tokens(t)[:-1]
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            ids[find(k)] = min(ids.get(find(k), r[0]), r[0])
    return sorted((str(r[0]), len(sets[k]), str(ids.get(find(k)) if sets[k] else r[0])) for k, r in enumerate(rows))


def test_near_duplicates(docs, rows, empty):
    out = neardup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicate_clusters(spark):
    """Many variants of one text, some too far from the first, and a shared passage."""
    r = random.Random(2)
    base, passage = prose(100, 90).split(), prose(101, 40)
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.randrange(7)):
            words[r.randrange(len(words))] = f"edit{r.randrange(4)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, prose(200 + i, 50) + " " + passage) for i in range(40)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out) == brute_components(rows)


@pytest.mark.parametrize("size", [20, 60, 100, 1000])
def test_recall_at_the_threshold(spark, size):
    """Pairs whose sets have exactly or hardly more than the least similarity."""
    r, texts, want = random.Random(size), [], {}
    for k in range(40):
        words = [f"w{r.randrange(10**9)}" for _ in range(size + 4)]
        other = list(words)
        # Changing a run of words at the end changes as many shingles.
        changed = (size + 2) // 8 if k % 2 else (size - 1) // 7
        other[-changed:] = [f"x{r.randrange(10**9)}" for _ in range(changed)]
        a, b = (set(zip(*[w[i:] for i in range(5)])) for w in (words, other))
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        want[2 * k + 1] = 2 * k if 100 * len(a & b) >= 75 * len(a | b) else 2 * k + 1
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert {k: out[k] for k in want} == want and any(k != v for k, v in want.items())


def test_hot_safe_join(spark):
    from lexbind.llm.common import hot_safe_join

    left = spark.createDataFrame([(i, i if i % 3 else -1) for i in range(6000)] + [(-5, None)], "id long, k long")
    right = spark.createDataFrame([(-1, 7)] + [(i, i) for i in range(0, 6000, 2)], "k long, v long")
    for how in ("inner", "left"):
        got, want = (sorted(map(tuple, d.select("id", "k", "v").fillna(-9).collect())) for d in (hot_safe_join(left, right, "k", how), left.join(right, "k", how)))
        assert got == want


def test_one_of_each(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(5, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (None, a, 5), (None, prose(3, 60), 6), (None, prose(3, 60), 7), (9, None, 8), (9, "", 9), (None, None, 10)]
    df = spark.createDataFrame([(*r, {"m": 1}, 0, 0) for r in rows], "doc_id long, text string, kept int, tag map<string,int>, stay int, _id int")
    out = neardup.one_of_each(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "", r.kept) for r in out.collect())
    assert [g[:2] for g in got] == sorted([("5", a), ("5", b), ("None", prose(3, 60)), ("9", ""), ("None", "")])
    assert neardup.one_of_each(df.limit(0)).count() == 0


# 6 ---------------------------------------------------------------------------


def luhn(x):
    return sum((v if k % 2 == 0 else v * 2 - 9 * (v > 4)) for k, v in enumerate(map(int, reversed(x)))) % 10 == 0


def brute_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = ["a.b@c.de_x@y.zz @a.b q@w", "é 1.2.3.4 1.2.3 4.5.6.7.8 999.1.1.1 01.002.3.0255", "4041 8949 7460 8795 x 4041894974608795-1 5", "+1 (724) 555-7058. +12 +1.2.3.4.5.6.7 +", "ü@x.y é@é.fr a%b@c-d.e", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 5000, "a" * 20000 + "@b.c", "1." * 3000, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" password=e9b9ed9cc9d9"]


def brute_features(t, kind, m):
    body, before, after = m[0], t[max(0, m.start() - pii.CONTEXT) : m.start()], t[m.end() : m.end() + 1]
    has = lambda p, x: bool(re.search(p, x))
    runs = len(re.sub("[0-9]+|[A-Z]+|[a-z]+", "x", body))
    return (
        pii.KINDS.index(kind), min(len(body) // 4, 10), len(re.sub("[^0-9]", "", body)) * 4 // max(1, len(body)), has("[A-Z]", body) * 2 + has("[a-z]", body),
        int(has("^[0-9a-fA-F]+$", body)), int(has("^(?:AKIA|ASIA|ghp_|gho_|sk_|sk-|xox[bp]-|eyJ|AIza)", body)), int(has("[\"'`]$", before) and has("^[\"'`]", after)),
        int(has(pii.CUES, before)), int(has(pii.CALL_CUES, before)), min(runs // 3, 5),
    )


def brute_candidates(t):
    base = [tuple(map(int, x.split(":")[1:])) for x in brute_spans(t).split(",") if x]
    out = []
    for kind, pattern, needs in (("secret", pii.ASSIGN, r"(?i)passw|pwd|secret|token|key"), ("key", pii.TOKEN, ""), ("number", pii.GROUPS, r"[0-9]{3}\)?[\x20.-][0-9]")):
        for m in re.finditer(pattern, t) if re.search(needs, t) else ():
            if not any(a < m.end() and m.start() < b for a, b in base):
                out.append((m.start(), -m.end(), kind, brute_features(t, kind, m)))
    return out


def brute_added(t, models, threshold):
    out = []
    for begin, end, kind, f in sorted(c for c in brute_candidates(t) if pii.score(models, c[3]) >= threshold):
        if not out or out[-1][2] <= begin:
            out.append((kind, begin, -end))
    return out


def test_pii_base_spans(spark, docs, rows, empty):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + k, r[1]) for k, r in enumerate(rows)] + [(999, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    scanned = pii.scan(df)
    out = {r.doc_id: r for r in pii.find_spans(scanned, *pii.fit(scanned)).withColumn("b", pii._listed(list(pii.BASE))).collect()}
    for i, t in data:
        assert out[i].b == brute_spans(t or ""), t
    nothing = pii.scan(empty)
    assert pii.find_spans(nothing, *pii.fit(nothing)).count() == 0


def test_pii_added_and_redacted(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(40)]
    quoted = [(i, f'{prose(i, 20)} api_key = "{keys[i]}" {prose(i, 5)}') for i in range(30)]
    bare = [(50 + i, f"{prose(i, 9)} {keys[30 + i]} {prose(i, 5)}") for i in range(5)]
    calls = [(70 + i, f"{prose(i, 5)} call (555) 010-{1000 + i} or password=e9b9ed{i}9cc9d9, token: abcdefgh {prose(i, 4)}") for i in range(12)]
    plain = [(100 + i, prose(i, 40) + " internationalisations") for i in range(60)]
    data = quoted + bare + calls + plain + [(900 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(*d, 0, 0) for d in data] + [(500, None, 0, 0)], "doc_id long, text string, wide int, kept int")
    scanned = pii.scan(df, tuple(df.columns))
    models, threshold = pii.fit(scanned)
    # Neither model sees the features that its labels come from.
    used = [{t[0] for tree in m[1:] for t in (tree, *tree[2:]) if isinstance(t, tuple)} for m in models]
    assert not used[0] & {6, 7, 8} and not used[1] & {1, 2, 3, 4, 5, 9}
    found = {r.doc_id: [(a.kind, a.s, a.e) for a in r.added] for r in pii.find_spans(scanned, models, threshold).collect()}
    assert found == {i: brute_added(t, models, threshold) for i, t in data} | {500: []}
    assert all(len(found[i]) == 1 for i, _ in quoted + bare) and not any(found[i] for i, _ in plain)
    clean = pii.redact(scanned, models, threshold)
    assert clean.columns == df.columns
    clean = {r.doc_id: r.text for r in clean.collect()}
    assert all(k not in t for k in keys[:35] for t in clean.values() if t)
    assert all(clean[i] == t for i, t in plain) and clean[500] is None


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.mark.parametrize("folds", [(1, 2, 3, 4), (0,), (0, 1, 2, 3, 4)])
def test_pii_positive_cells_in_some_folds_only(spark, folds):
    """Secrets are added wherever their rows fall: none in a fold, or all in one."""
    ids = [i for i in range(2000) if fold(i) in folds][:200]
    keys = {i: hashlib.sha1(str(i).encode()).hexdigest() for i in ids}
    rows = [(i, f'{prose(i, 12)} api_key = "{keys[i]}" {prose(i + 1, 5)}') for i in ids]
    rows += [(5000 + i, prose(i, 30) + " internationalisations") for i in range(60)]
    scanned = pii.scan(spark.createDataFrame(rows, "doc_id long, text string"), ("doc_id", "text"))
    models, threshold = pii.fit(scanned)
    found = {r.doc_id: [(a.s, a.e) for a in r.added] for r in pii.find_spans(scanned, models, threshold).collect()}
    for i, t in rows:
        assert [keys.get(i, "?") in t[s:e] for s, e in found[i]] == [True] * (i in keys)


# 7 ---------------------------------------------------------------------------


def test_decontamination(spark, empty):
    items = [(i, prose(500 + i, 30 + i % 20)) for i in range(40)]
    docs = [(i, prose(i, 150)) for i in range(150)]
    leaked = []
    for k in range(12):
        words = items[k][1].split()
        if k % 3 == 1:  # a light paraphrase
            words = [w for j, w in enumerate(words) if j % 9 != 4]
        leaked.append((1000 + k, prose(2000 + k, 70) + " " + " ".join(words).upper() + ". " + prose(3000 + k, 50)))
    df = spark.createDataFrame(docs + leaked + [(5000, None), (5001, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string")
    out = {r.doc_id: r for r in latent.decontaminate(df, bench).collect()}
    assert all(list(out[1000 + k].item_ids) == [k] for k in range(12))
    assert not any(out[i].contaminated for i, _ in docs) and not out[5000].contaminated
    kept = {r.doc_id for r in latent.clean(df, bench).collect()}
    assert kept == {i for i in out if not out[i].contaminated}
    assert latent.decontaminate(empty, bench).count() == 0
    assert latent.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_common_passages(spark):
    items = [(i, prose(500 + i, 30 + i % 20)) for i in range(40)] + [(50, "alpha beta")]
    texts = [prose(i, 150) for i in range(120)]
    held = {k: {0} for k in range(0, 120, 3)}  # item 0 in a third of the rows
    for k in held:
        texts[k] += f" {items[0][1]}"
    for k in range(1, 120, 12):  # item 1 in every twelfth
        texts[k] += f" {items[1][1]} " + prose(900 + k, 30)
        held[k] = {1}
    texts[2] += " Alpha, beta!"
    held[2] = {50}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: set(r.item_ids) for r in latent.decontaminate(df, bench).collect() if r.contaminated} == held
    # A table of few rows: every word that occurs is common there.
    few = df.where("doc_id < 8")
    assert {r.doc_id: set(r.item_ids) for r in latent.decontaminate(few, bench).collect() if r.contaminated} == {k: v for k, v in held.items() if k < 8}
    assert {r.doc_id for r in latent.clean(few, bench).collect()} == {4, 5, 7}


def test_decontamination_rows_and_blocks(spark, monkeypatch):
    """Rows are judged one by one, over several blocks of items; no shared word, ties, long and short texts."""
    items = [(i, prose(500 + i, 30)) for i in range(5)] + [(7, "one two three"), (8, prose(503, 30))]
    rows = [(1, prose(1, 80) + " " + items[0][1]), (1, "#"), (None, items[1][1]), (None, "nothing"), (2, prose(3, 20000) + " " + items[2][1] + " " + prose(4, 20000))]
    rows += [(3, "one gap two three"), (4, "say: One, two three."), (5, items[3][1]), (6, None), (6, "")]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, item_ids int, share int, _items int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted([("1", [0]), ("1", []), ("None", [1]), ("None", []), ("2", [2]), ("3", []), ("4", [7]), ("5", [3, 8]), ("6", []), ("6", [])])
    for block in (5000, 2):
        monkeypatch.setattr(latent, "ITEM_BLOCK", block)
        assert sorted((str(r.doc_id), list(r.item_ids)) for r in latent.decontaminate(df, bench).collect()) == want
        kept = latent.clean(df, bench)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(k for k, v in want if not v)
    # An item without an id marks its copies too.
    nameless = spark.createDataFrame([(None, items[0][1]), (None, "one two three"), (1, items[1][1])], "item_id long, text string")
    marked = latent.decontaminate(df, nameless).where("contaminated").collect()
    assert sorted((str(r.doc_id), list(r.item_ids)) for r in marked) == [("1", []), ("4", []), ("None", [1])]
    assert latent.clean(df, nameless).count() == len(rows) - 3
    # No document has a word of the benchmark.
    odd = spark.createDataFrame([(1, "?!"), (2, "zzz yyy")], "doc_id long, text string")
    assert latent.decontaminate(odd, bench).where("contaminated").count() == 0


def test_retrieval_against_brute_force(spark):
    """Recall over planted copies with a growing share of changed words: whatever
    the subsequence and answer checks confirm anywhere in a text must be found."""
    r = random.Random(5)
    items = [(i, prose(700 + i, r.randint(15, 60))) for i in range(60)]
    texts = []
    for i in range(150):
        words = items[i % 60][1].split()
        changed = [w if r.random() > i % 6 * 0.1 else prose(10**6 + i, 1) for w in words]
        texts.append((i, f"{prose(2000 + i, 90)} {' '.join(changed)} {prose(4000 + i, 40)}"))
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(row.doc_id, i) for row in latent.decontaminate(df, bench).collect() for i in row.item_ids}
    (block,) = latent.item_blocks(bench)
    block.weigh(*latent.document_frequencies(df, block))
    want = set()
    for d, t in texts:
        codes, _ = latent._coded(pa.array([t]), block.index)
        for k, item in enumerate(block.codes):
            masks = {c: sum(1 << j for j, x in enumerate(item.tolist()) if x == c) for c in set(item.tolist())}
            if any(latent.confirmed(codes[a : a + 16 * 4 + 16], item, masks, block.answers[k]) for a in range(0, len(codes), 16)):
                want.add((d, k))
    assert len(want & found) >= 0.95 * len(want) and len(want) > 90


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 25))] for _ in range(2))
        masks = {}
        for k, x in enumerate(b):
            masks[x] = masks.get(x, 0) | 1 << k
        assert latent.lcs(a, masks, len(b)) == slow(a, b)


# 8 ---------------------------------------------------------------------------


def test_ring(docs, empty):
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    out = ring.bounded_ring(docs, key, [F.col("doc_id"), key], 8).collect()
    loads = Counter(r.shard for r in out)
    assert len(out) == docs.count() and max(loads.values()) - min(loads.get(s, 0) for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(loads.get(s, 0)))
    assert ring.bounded_ring(empty, key, [F.col("doc_id")], 8).count() == 0


def test_ring_columns_and_movement(spark):
    df = spark.range(20_000).select("id", F.lit(1).alias("shard"), F.lit(2).alias("slot"), F.lit(3).alias("home_shard"))
    out = ring.bounded_ring(df, F.col("id"), [F.col("id")], 8)
    assert set(out.columns) == {"id", "input_shard", "input_slot", "input_home_shard", "shard", "slot", "home_shard"}
    assert out.where("input_shard = 1 and input_slot = 2 and input_home_shard = 3").count() == 20_000
    place = lambda frame, n: {r.id: r.shard for r in ring.bounded_ring(frame, F.col("id"), [F.col("id")], n).select("id", "shard").collect()}
    eight, nine, fewer = place(df, 8), place(df, 9), place(df.where("id % 100 <> 0"), 8)
    # A plain rehash moves 8 of 9 rows; without a hundredth of the rows it moves none, the quotas a few.
    assert sum(eight[k] != nine[k] for k in eight) < 0.45 * len(eight)
    assert sum(eight[k] != fewer[k] for k in fewer) < 0.10 * len(fewer)


def test_clashing_columns(spark):
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept", "_k0", "_in1", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip", "piece_ids"]
    df = spark.createDataFrame([(i, prose(i, 60), *range(len(own))) for i in range(5)], "doc_id long, text string, " + ", ".join(f"{c} int" for c in own))
    model = quality.train([(prose(i, 60), i % 2, i % 5) for i in range(20)])
    kept = quality.keep_good(df, (model[0], 0.0, 40.0))
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())
    scored = quality.score(df, model, ("kept", "quality", "text"))
    assert scored.columns[-3:] == ["input_kept", "input_quality", "text"] and scored.where("input_kept = 7 and input_quality = 6").count() == 5
    public_tokenizers = pytest.importorskip("public_tokenizers")
    coded = pieces.encode_decode(df, public_tokenizers.path("piece_bpe_32k.model"), ("round_trip", "n_words"), True)
    assert coded.columns[-2:] == ["input_round_trip", "n_words"] and coded.where("round_trip and input_round_trip = 13").count() == 5


def test_ring_hot_key(spark):
    df = spark.range(3000).withColumn("text", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")))
    out = ring.bounded_ring(df, F.col("text"), [F.col("id")], 8).collect()
    assert set(Counter(r.shard for r in out).values()) == {375}
    assert sum(r.shard != r.home_shard for r in out) < 1500


# 9 ---------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "<html>" + "é" * 200
    rows = [(5, "u5", big), (2, "u\n2", big), (9, None, big), (1, "u", "x"), (3, "u", "x"), (4, "u", None), (7, "u", "y" * 900_000), (8, "u", ""), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_digest int")
    bundles = warc.write_bundles(warc.with_originals(pages))
    out = {r.page_id: r for r in warc.read_bundles(bundles).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert out[i].payload_bytes == len(raw) and out[i].payload_digest == hashlib.sha256(raw).hexdigest()
        again = html == big and i != 2
        assert (out[i].record_type, out[i].refers_to) == (("revisit", 2) if again else ("response", None))
    for r in bundles.collect():
        reader = warc.BundleReader(bytes(r.image))
        for entry in reader.index:
            assert warc.parse_record(reader.find(entry[0])[0])
    import zstandard

    path = warc.export_bundles(bundles, str(tmp_path))[0]
    with open(path, "rb") as f:  # plain readers skip the index and the seek table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1")
    assert warc.read_bundles(warc.write_bundles(warc.with_originals(pages.limit(0)))).count() == 0


# 10 --------------------------------------------------------------------------


def test_pieces_equal_the_library(docs, rows, empty):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    coder = pieces.Encoder(path)
    texts = [r[1] or "" for r in rows] + ["", " ", "a  b\n c d  ", "<s>a<0x41>b▁c</s>", "日本語 😀 x", "ab" * 3000, "    lead", "ﬁ①Å\u0000z", "tail   \n   "]
    for t, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == sp.encode(t)
        assert coder.decode(ids) == t.replace("▁", " ")
    out = pieces.encode_decode(docs, path, ("lang", "kept")).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    assert pieces.encode_decode(empty, path).count() == 0


def test_unigram_path_is_best():
    public = pytest.importorskip("public_tokenizers")
    coder = pieces.Encoder(public.path("piece_bpe_32k.model"))
    v = coder.vocabulary
    v.bpe, v.score = False, -np.log(2.0 + np.arange(v.size))
    word = "▁inter"
    ids = np.frombuffer(coder._indexed([word])[0], "<u4").tolist()

    def best(s):
        return max((v.score[v.id_of[s[:k]]] + (best(s[k:]) if k < len(s) else 0) for k in range(1, len(s) + 1) if s[:k] in v.id_of), default=-1e9)

    assert abs(sum(v.score[i] for i in ids) - best(word)) < 1e-9


def test_shuffle_files_go_with_their_job(spark):
    import time

    from lexbind.llm import common

    def files() -> set[str]:
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in held.split("\n") if f.endswith(".data")}

    before = files()
    with common.shuffles_end(spark):
        kept = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    assert kept.count() == 7
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    left = files() - before
    common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "held")
    assert files() - before - left and len(left) <= 1  # the count above has one of its own


def test_simple8b_words_go_through_together():
    import public_tokenizers

    tokenizer = simple8b._encoder(public_tokenizers.path("word_bpe_49k.json"))[0]

    class Counted:
        calls = 0

        def encode(self, *args, **kwargs):
            Counted.calls += 1
            return tokenizer.encode(*args, **kwargs)

        encode_batch_fast = tokenizer.encode_batch_fast

    for words, calls in ((["the", "'s", "7", "ñandú", "!?", "zorglingcrumpot", "the"], 1), (["ab1", "x"], 2)):
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        assert simple8b._encode_words(words, Counted()) == want and Counted.calls == calls
    ids = np.array([0, 1, 2, 3, 2**20 - 1, 2**20, 2**52 - 1], np.uint64)
    assert simple8b._bits(ids).tolist() == [max(1, int(x).bit_length()) for x in ids]
    assert simple8b._bits(np.append(ids, np.uint64(2**63))).tolist()[-1] == 64
