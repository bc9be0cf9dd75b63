"""The operators against brute force, public libraries and exact round trips, and their edge cases."""

from __future__ import annotations

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import bpe, chat, crf, fingerprint, jaccard, license, media, mixture, quality, shingles, warc

WORDS = [f"w{k}" for k in range(400)]
EDGE = [(1, None, "en", None), (2, "", "en", "a"), (3, "one two", None, "b"), (3, "one two", None, "b"), (None, "one two", "en", "b"), (5, "x" * 30_000, "en", "a"), (6, " \n\t ", "en", None)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, -1, "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, score int, row string")


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    base = [" ".join(r.choices(WORDS, k=r.randint(3, 120))) for _ in range(60)]
    passage = " ".join(r.choices(WORDS, k=70))
    out = []
    for k in range(260):
        words = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = r.choice(WORDS)
        text = " ".join(words)
        out.append((k, passage + " " + text if k % 5 == 0 else text.upper() if k % 7 == 0 else text, "en", f"s{k % 3}"))
    return out + [(900 + k, passage, "en", "s0") for k in range(40)]


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


LOW, HIGH = -(1 << 63), (1 << 63) - 1


def test_ids_at_both_ends(spark):
    """Ids near the ends of 64 bits, as hashes are, for op2, op3 and op10."""
    same = " ".join(WORDS[:40])
    ids = [LOW, LOW + 1, LOW + 2, -1, 0, HIGH - 2, HIGH - 1, HIGH]
    rows = [(i, same + " " * k + f" w{k}", "en", "s") for k, i in enumerate(ids)] + [(None, "one", "en", "s"), (None, "two", "en", "s")]
    docs = documents(spark, rows)
    for links in (False, True):
        got = {r["doc_id"]: r for r in jaccard.jaccard_components(docs, links=links).collect()}
        assert {got[i]["component_id"] for i in ids} == {LOW} and (not links or {got[i]["n_links"] for i in ids} == {7})
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.edited_fingerprints(docs).collect() if r["doc_id"] is not None}
    down = sorted(((i, t) for i, t, *_ in rows if i is not None), reverse=True)
    for (i, t), (_, n) in zip(down, down[1:], strict=False):
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    pages = spark.createDataFrame([(i, f"http://h/{i}", "p" * (i % 3)) for i in ids], "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    index = warc.build_index(archives)
    found = {r["page_id"]: r for r in warc.read_records(archives, warc.captures_of(index, warc.directory_of(index), warc.keys_of(pages))).collect()}
    assert sorted(found) == ids
    for i in ids:
        first = min(j for j in ids if j % 3 == i % 3)
        assert found[i]["refers_to"] == (None if i == first else first)


@pytest.mark.parametrize("frequent", [2, 64])
def test_jaccard_brute_force(spark, corpus, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "VERY", 16 if frequent == 2 else 4096)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents(spark, corpus)).collect()}
    assert got == brute_components(corpus)


def test_units_hold_every_pair_of_linked_sizes(spark, monkeypatch):
    """A component whose sets have very different sizes, in blocks of a few documents or of a few tokens."""
    r = random.Random(21)
    base = r.choices([f"w{k}" for k in range(3000)], k=160)
    rows = [(k, " ".join(base[: 12 + 2 * k]), "en", "s") for k in range(70)] + [(100 + k, " ".join(base[: 40 + k] + [f"u{k}"]), "en", "s") for k in range(12)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in rows}
    want = {a: sum(a != b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    for block, tokens in ((5, 1 << 20), (1024, 300)):
        monkeypatch.setattr(jaccard, "BLOCK_TOKENS", tokens)
        verified = jaccard.verified_edges
        with monkeypatch.context() as m:
            m.setattr(jaccard, "verified_edges", lambda *a, verified=verified, block=block, **b: verified(*a, **b, block=block))
            got = {x["doc_id"]: (x["n_links"], x["component_id"]) for x in jaccard.jaccard_components(documents(spark, rows), links=True).collect()}
        assert got == {i: (want[i], 0) for i in want}


def test_jaccard_edges(spark):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.jaccard_components(documents(spark, EDGE)).collect())
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 1, "3"), ("3", 1, "3"), ("None", 1, "None"), ("5", 1, "5"), ("6", 0, "6")])
    assert jaccard.jaccard_components(documents(spark, EDGE).limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    verified = jaccard.verified_edges
    monkeypatch.setattr(jaccard, "verified_edges", lambda *a, **b: verified(*a, **b, block=block))
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(base[:k] + [f"other{k}"] + base[k + 1 :]), "en", "s") for k in range(12)] + [(20 + k, " ".join(base), "en", "s") for k in range(3)]
    rows += [(40, " ".join(f"v{k}" for k in range(30)), "en", "s"), (20, " ".join(base), "en", "s"), (50, "", "en", "s")]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in rows}
    want = {a: sum(a != b and bool(sets[a]) and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    got = jaccard.jaccard_components(documents(spark, rows), links=True).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and want[21] > 12 and len(got) == len(rows)
    plain = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert sorted(r[:4] for r in got) == sorted(tuple(r) for r in plain)


def test_keys_reach_every_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(2, 400))
        common = np.sort(r.choice(1 << 40, n, replace=False).astype(np.uint64)) * np.uint64(1 << 8)
        away = int(r.integers(0, n // 7 + 1))
        other = np.sort(np.concatenate([common[away:], r.choice(1 << 40, away, replace=False).astype(np.uint64) * np.uint64(1 << 8)]))
        both = len(np.intersect1d(common, other))
        if 100 * both < 75 * (2 * n - both):
            continue
        count = {}
        hits = []
        for x in (common, other):
            short = np.unique(x >> np.uint64(16))[: jaccard.prefix_of(len(x))[0]]
            hits.append(short)
        for t in np.concatenate(hits).tolist():
            count[t] = count.get(t, 0) + 1
        heavy = r.integers(2, 5000, 7)
        keys = []
        for x, h in zip((common, other), hits, strict=True):
            h = np.array([t for t in h.tolist() if count[t] > 1], dtype=np.uint64)
            keys.append(set(jaccard.keys_of(len(x), h, np.array([heavy[t % 7] for t in h.tolist()])).tolist()))
        assert keys[0] & keys[1]


def test_pack_round_trip():
    for n in (0, 1, 9):
        a, b = np.arange(n, dtype=np.uint64) * np.uint64(1 << 50), np.arange(n, dtype=np.uint16)
        x, y = jaccard._unpack(jaccard._pack(a, b), "<u8", "<u2")
        assert (x == a).all() and (y == b).all() and len(x) == len(y) == n


def test_jaccard_without_common_tokens(spark):
    rows = [(k, " ".join(f"u{k}x{j}" for j in range(9)), "en", "s") for k in range(20)]
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 5 for r in got) and len(got) == 20


def test_forest():
    pairs = np.array([[1, 2], [2, 3], [9, 8], [3, 1], [10, 9]])
    assert sorted(map(tuple, jaccard.forest(pairs).tolist())) == [(1, 2), (1, 3), (8, 9), (8, 10)]


def test_crf_marginals_are_exact():
    t = crf.Tagger(bias=-1.7, moves=(0.0, -1.2, -0.4, 0.6))
    for n, given in ((1, {0: 0.3}), (7, {0: 1.1, 3: 2.0}), (9, {4: -0.5, 5: 1.5, 8: 0.2})):
        move = np.exp(np.array(t.moves)).reshape(2, 2)
        emit = [np.array([1.0, math.exp(given.get(i, t.bias))]) for i in range(n)]
        whole = none = 0.0
        inside = np.zeros(n)
        for states in itertools.product((0, 1), repeat=n):
            w = emit[0][states[0]]
            for i in range(1, n):
                w *= move[states[i - 1], states[i]] * emit[i][states[i]]
            whole += w
            none += w if not any(states) else 0
            inside += w * np.array(states)
        p, log_none, expected = t.marginals(given, n)
        assert np.allclose(p, [inside[i] / whole for i in sorted(given)])
        assert math.isclose(expected, inside.sum() / whole, rel_tol=1e-9)
        assert math.isclose(log_none, math.log(none / whole), rel_tol=1e-9)


def test_crf_marginals_of_every_token():
    """All tokens of random chains, strong and alternating moves included, against enumeration."""
    r = random.Random(11)
    for k in range(60):
        n = r.randint(1, 11)
        t = crf.Tagger(words={"m": r.uniform(-3, 6)}, bias=r.uniform(-4, 1), moves=(0.0, *(r.uniform(-4, 4) for _ in range(3))))
        words = r.choices(["m", "x"], weights=[1, 3], k=n)
        given = t.emissions(words)
        states = np.array(list(itertools.product((0, 1), repeat=n)))
        emit = np.array([given.get(i, t.bias) for i in range(n)])
        log = states @ emit
        for i in range(1, n):
            log = log + np.array(t.moves)[2 * states[:, i - 1] + states[:, i]]
        w = np.exp(log - log.max())
        want = (w @ states) / w.sum()
        p, _, expected, gaps = t.passes(given, n)
        assert np.allclose(p, want[sorted(given)]) and math.isclose(expected, want.sum(), rel_tol=1e-8)
        for g in gaps:
            own = want[g.first : g.first + g.length]
            assert np.allclose(g.marginals(), own) and g.bound() >= own.max() - 1e-9 and np.allclose(g.edges(), (own[0], own[-1]))
        _, spans = t.tag(" ".join(words))
        near = np.abs(want - 0.5) < 1e-9
        got = np.zeros(n, dtype=bool)
        for a, b, _ in spans:
            got[a // 2 : b // 2 + 1] = True
        if given and not near.any():
            assert (got == (want >= 0.5)).all()


def test_crf_spans_widen_over_plain_tokens():
    t = crf.Tagger(words={"vile": 9.0}, bias=-3.5, moves=(0.0, 0.0, 0.0, 4.0))
    score, spans = t.tag("a b c d e f vile g h i j k")
    p, _, expected, _ = t.passes({6: 5.5}, 12)
    assert len(spans) == 1 and spans[0][1] - spans[0][0] > len("f vile g") and expected > 8
    assert t.tag("\u0130\u0130\u0130\u0130 vile x")[1][0][0] <= 5 and "vile" in "\u0130\u0130\u0130\u0130 vile x"[slice(*t.tag("\u0130\u0130\u0130\u0130 vile x")[1][0][:2])]
    alone = crf.Tagger(words={"vile": 9.0}, bias=-6.0)
    assert alone.tag("\u0130\u0130\u0130\u0130 vile x")[1][0][:2] == (5, 9)


def test_toxicity_held_out(spark):
    r = random.Random(5)
    bad = ["vile", "nasty", "grim"]
    rows, labels = [], []
    for k in range(500):
        w = r.choices(WORDS, k=60)
        toxic = k % 4 == 0
        if toxic:
            for b in r.sample(bad, 2):
                w[r.randrange(60)] = b
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (700, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in crf.toxicity(documents(spark, rows + [(901, None, "en", "s"), (902, "", "en", "s")]), lab).collect()}
    held = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in held) for k in range(500))
    assert np.mean([got[k]["predicted"] == (k % 4 == 0) for k in held]) > 0.95
    assert got[901]["score"] == got[902]["score"] < 0.5
    hit = got[next(k for k in held if k % 4 == 0)]
    assert {rows[hit["doc_id"]][1][s["start"] : s["end"]] for s in hit["spans"]} <= set(bad) and hit["spans"]
    empty = crf.toxicity(documents(spark, EDGE), lab.limit(0)).collect()
    assert len(empty) == len(EDGE) and len({r["score"] for r in empty}) == 1


def test_toxicity_edges(spark):
    r = random.Random(6)
    rows = [(k, " ".join([*r.choices(WORDS, k=20), *(["vile", "nasty"] if k % 2 else []), *r.choices(WORDS, k=20)]), "en", "s") for k in range(120)]
    both = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(k, 0) for k in range(1, 120, 2)], "doc_id long, toxic int")
    train = crf.training_rows(documents(spark, rows), both)
    assert len(train) == sum(zlib.crc32(str(k).encode()) % 5 > 0 for k in range(120)) and all(y == ("vile" in t) for t, y in train)
    tagger = crf.fit(train)
    assert crf.fit(train[::-1]).words.keys() == tagger.words.keys()
    text = "w1 w2 VILE nasty w3 " + "w4 " * 50 + "nasty"
    score, spans = tagger.tag(text)
    assert score > 0.5 and [text[a:b] for a, b, _ in spans] == ["VILE nasty", "nasty"]
    for words in ("w1 vile", "vile", "w1 w2 w3", "nasty w1 w2 vile vile w4"):
        w = words.split()
        p = tagger.inputs(w)[0]
        move = np.exp(np.array(tagger.moves)).reshape(2, 2)
        emit = [tagger.emission(x) if tagger.emission(x) is not None else tagger.bias for x in w]
        inside, whole = np.zeros(len(w)), 0.0
        for states in itertools.product((0, 1), repeat=len(w)):
            x = math.prod(math.exp(e) if s else 1.0 for s, e in zip(states, emit, strict=True)) * math.prod(move[a, b] for a, b in zip(states, states[1:], strict=False))
            whole += x
            inside += x * np.array(states)
        assert all(math.isclose(v, inside[i] / whole, rel_tol=1e-6) for i, v in p.items())
    assert crf.toxicity(documents(spark, rows).limit(0), both).count() == 0
    long = [(1, "w1 " * 400_000 + "vile nasty", "en", "s")] * 2
    got = crf.toxicity(documents(spark, rows + [(500 + k, t, *x) for k, (_, t, *x) in enumerate(long)]), both).where("doc_id >= 500").collect()
    assert len(got) == 2 and got[0]["score"] == got[1]["score"] and got[0]["spans"][0]["start"] == 1_200_000


def test_window_classes_match_entropy():
    data = np.frombuffer(("abcabcaab" * 9 + "xyz" * 20 + "a" * 70).encode(), dtype=np.uint8)
    got = fingerprint.window_classes(data)
    for i in range(len(got)):
        c = Counter(data[i : i + fingerprint.WINDOW].tolist())
        h = math.log2(fingerprint.WINDOW) - sum(v * math.log2(v) for v in c.values()) / fingerprint.WINDOW
        assert abs(got[i] - h / math.log2(fingerprint.WINDOW) * (fingerprint.CLASSES - 1)) <= 1


def test_fingerprints_dont_depend_on_batches(corpus):
    texts = [t.encode() for _, t, *_ in corpus] + [b"", b"short", b"z" * 500]
    counts = np.ones(fingerprint.CLASSES, dtype=np.int64)
    ranks = fingerprint.ranks_of(counts)
    together = fingerprint.features(texts, ranks)
    for t, f in zip(texts, together, strict=True):
        assert (fingerprint.features([t], ranks)[0] == f).all()


def test_edited_fingerprints(spark, corpus):
    rows = corpus[:80] + [(2000, None, "en", "a"), (2001, "tiny", "en", "a"), (2002, "é" * 100 + " ü" * 50, "en", "b")]
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text, *_) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 3] + nxt[: len(text) // 3]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1
    long = [i for i, t, *_ in rows if t and len(t) > 200 and got[i]["near_next"] < 0.3]
    assert np.mean([got[i]["near_edited"] > 0.35 for i in long]) > 0.9
    assert fingerprint.edited_fingerprints(documents(spark, rows[:1])).first()["near_next"] == 1.0
    assert fingerprint.edited_fingerprints(documents(spark, EDGE)).count() == len(EDGE)
    assert fingerprint.edited_fingerprints(documents(spark, EDGE).limit(0)).count() == 0


def slow_windows(text, ranks):
    """Features by loops: the leftmost window of the best rank of every run scores, windows of enough points stay."""
    w, n = fingerprint.WINDOW, len(text) - fingerprint.WINDOW + 1

    def rank(i):
        c = Counter(text[i : i + w])
        total = sum(int(fingerprint._TERM[v]) for v in c.values())
        return int(ranks[(int(fingerprint._MOST) - total) * (fingerprint.CLASSES - 1) // int(fingerprint._MOST)])

    own, points = [rank(i) for i in range(n)], Counter()
    for a in range(-(fingerprint.RUN - 1), n):
        run = [i for i in range(max(0, a), min(n, a + fingerprint.RUN)) if own[i] < fingerprint._NO_RANK]
        if run:
            points[min(run, key=lambda i: (own[i], i))] += 1
    return list(dict.fromkeys(text[i : i + w] for i in sorted(points) if points[i] >= fingerprint.MIN_POINTS))


def slow_likeness(a, b):
    """Likeness of two chains of filters, as sets of bits."""
    a, b = ([{i for i, x in enumerate(np.unpackbits(row)) if x} for row in c] for c in (a, b))
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a

    def one_way(x, y):
        got = 0.0
        for f in x:
            best = 0.0
            for g in y:
                chance, most = len(f) * len(g) / fingerprint.BITS, min(len(f), len(g))
                share = min(1.0, max(0.0, (len(f & g) - chance) / max(most - chance, 1e-9)))
                best = max(best, share * math.sqrt(most / max(len(f), len(g), 1)))
            got += len(f) * best
        return got / max(1, sum(map(len, x)))

    return one_way(a, b) if len(a) < len(b) else (one_way(a, b) + one_way(b, a)) / 2


def test_plan_doesnt_grow_with_its_ranges(spark):
    df = spark.range(10).select((F.col("id") * 7 - 30).alias("k"), F.col("id").alias("h"))
    nodes, lots = [], []
    for n in (10, 10_000):
        cuts = [(k, (1 << 63) - 1) for k in range(-n // 2, n // 2)]
        plan = df.select("k", fingerprint._lot_of(cuts).alias("lot"))
        nodes.append(len(re.findall(r"lambda|struct|filter", plan._jdf.queryExecution().analyzed().toString())))
        lots.append([r["lot"] for r in plan.collect()])
        assert lots[-1] == [sum(c < (r["k"], r["h"]) for c in cuts) for r in df.collect()]
    assert nodes[0] == nodes[1]


def test_fingerprints_match_loops(corpus):
    texts = [t.encode() for _, t, *_ in corpus[:25]] + [b"ab" * 40 + b"the end of it all is near, they say", ("né " * 30).encode()]
    counts = np.zeros(fingerprint.CLASSES, dtype=np.int64)
    for t in texts:
        np.add.at(counts, fingerprint.window_classes(np.frombuffer(t, dtype=np.uint8)), 1)
    ranks = fingerprint.ranks_of(counts)
    got = fingerprint.features(texts, ranks)
    for t, f in zip(texts, got, strict=True):
        want = slow_windows(t, ranks)
        assert len(want) == len(f) or not want and len(f) >= 1
    chains = [fingerprint.filters(f) for f in got] + [fingerprint.filters(np.concatenate(got))]
    for a, b in itertools.product(chains[:6] + chains[-1:], chains[-8:]):
        assert math.isclose(fingerprint.likeness(a, b), slow_likeness(a, b), abs_tol=1e-12)
        assert math.isclose(fingerprint.likeness(a, b), fingerprint.likeness(b, a), abs_tol=1e-12)


def test_edited_fingerprints_of_hot_ids(spark):
    texts = [f"text {k} " + "word " * (k % 50) for k in range(300)]
    rows = [(None, t, "en", "a") for t in texts[:120]] + [(5, t, "en", "a") for t in texts[120:240]] + [(k, t, "en", "a") for k, t in enumerate(texts[240:])] + [(None, texts[0], "en", "a")] * 3
    long = "long " * 300_000
    got = fingerprint.edited_fingerprints(documents(spark, [*rows, (900, long, "en", "a")])).collect()
    assert len(got) == len(rows) + 1 and sum(r["doc_id"] is None for r in got) == 123
    assert {r["n_chars"] for r in got} == {len(t) for t in [*texts, long]}
    own = {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    # descending ids: those of distinct ids are known to the row
    order = sorted([r for r in [*rows, (900, long, "en", "a")] if r[0] is not None and r[0] != 5], key=lambda r: -r[0])
    by = {r["doc_id"]: r["edited_sha256"] for r in got if r["doc_id"] not in (None, 5)}
    for (i, t, *_), (j, n, *_) in zip(order, order[1:], strict=False):
        if i - 1 == j:
            assert by[i] == hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    assert own


def test_license_labels(spark):
    text = "Under the MIT License. under the mit license; Apache License, Version 2.0 -- CC BY-NC 4.0"
    rows = [(1, text, "en", "a"), (2, "Released under the terms of the MIT license", "en", "a"), (3, "released under mit license", "en", "a"), *[(10 + k, t, *x) for k, (_, t, *x) in enumerate(EDGE)]]
    got = {r["doc_id"]: r for r in license.license_labels(documents(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (4, 0, 13, "apache-2,cc-by-nc,mit")
    assert got[2]["labels"] == "mit-notice" and got[2]["n_base"] == 0 and got[2]["score"] == 1.0
    assert got[3]["labels"] == "" and got[3]["score"] < 1 and got[10]["n_words"] == 0 and got[10]["first_word"] is None


def pattern_of(template):
    """The template as a regular expression over words that each end with a blank."""
    out = ""
    for item in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[0-9a-z]+", template):
        out += "(?:" if item == "[[" else ")?" if item == "]]" else rf"(?:\S+ ){{0,{item[2:-2]}}}" if item[0] == "{" else item + " "
    return re.compile(out)


def slow_matches(words, templates):
    """(label, first word, end) by trying every end of every start, longest first."""
    out = set()
    for label, t in templates.items():
        p = pattern_of(t)
        for a in range(len(words)):
            if p.match("".join(w + " " for w in words[a:])):
                out.add((label, a, next(b for b in range(len(words), a, -1) if p.fullmatch("".join(w + " " for w in words[a:b])))))
    return out


def test_template_automaton():
    a = license.Automaton("a b [[c d]] e {{2}} f [[g]]")
    for words, end in (("a b e f", 4), ("a b c d e f g", 7), ("a b c e f", None), ("a b e x f f", 6), ("a b e x y f z", 6), ("a b e x y z f", None), ("a b e", None)):
        assert a.match([w.encode() for w in words.split()], 0)[0] == end, words
    r = random.Random(3)
    short = {"one": "a b [[c [[d]] e]] {{2}} f [[{{1}} g]]", "two": "b [[a]] [[a b]] c", "three": "f"}
    automata = [(k, license.Automaton(t)) for k, t in short.items()]
    starts = {}
    for k, (_, x) in enumerate(automata):
        for w in x.first:
            starts.setdefault(w, []).append(k)
    for _ in range(400):
        words = r.choices("abcdefg", k=r.randint(0, 14))
        assert set(license.scan(" ".join(words).encode(), [], automata, starts)[2]) == slow_matches(words, short), words


def test_license_texts(spark):
    r = random.Random(8)
    rows, want = [], []
    for label, t in license.TEMPLATES.items():
        plain = re.sub(r"\{\{\d+\}\}", "some one", re.sub(r"\[\[|\]\]", " ", t)).split()
        for change in (False, True):
            words = list(plain)
            if change:
                words[r.randrange(1, 4)] = "otherwise"
            rows.append((len(rows), "Preface. " + " ".join(words).capitalize() + " rest", "en", "s"))
            want.append({x[0] for x in slow_matches(re.findall("[0-9a-z]+", rows[-1][1].lower()), license.TEMPLATES)})
            assert change or label in want[-1]
    assert sum(not w for w in want) > 6
    rows += [(100, "x " * 500_000 + "under the MIT license", "en", "s"), (100, "x " * 500_000 + "under the MIT license", "en", "s")]
    got = license.license_labels(documents(spark, rows)).collect()
    by = {x["doc_id"]: x for x in got}
    assert all({m["label"] for m in by[k]["matches"]} == w for k, w in enumerate(want)) and len(got) == len(rows)
    assert by[100]["first_word"] == 500_000 and by[100]["n_base"] == 1
    assert license.license_labels(documents(spark, EDGE).limit(0)).count() == 0


def brute_mix(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size))
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * own[s]]
        if not over:
            return size, own, {**target, **{s: left * weight[s] / w for s in free}}
        for s in over:
            target[s] = 3.0 * own[s]
        free -= set(over)
        left = sum(size) - sum(target.values())
    return size, own, target


def test_mixture(spark, corpus):
    rows = [*corpus, *EDGE]
    size, own, target = brute_mix(rows)
    got = mixture.mixed(documents(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(size)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert set(by) == {(own[s], round(target[s], 6)) for s in own}
    assert all(abs(sum(v) - t) <= 1 for (_, t), v in by.items())
    places = [r["position"] for r in got if r["position"] is not None]
    assert places == sorted(places) and 0 <= places[0] <= places[-1] <= 1
    assert [r.asDict() for r in mixture.mixed(documents(spark, rows)).collect()] == [r.asDict() for r in got]
    assert mixture.mixed(documents(spark, EDGE).limit(0)).count() == 0
    assert mixture.mixture(documents(spark, rows)).columns == documents(spark, EDGE).columns


def test_inverse_demand(spark):
    knots = mixture.SCHEDULES[2]
    df = spark.range(101).select((F.col("id") / 100.0).alias("u")).withColumn("t", mixture.inverse_demand(F.col("u"), knots))

    def area(t):
        grid = np.linspace(0, t, 4001)
        return np.trapezoid(np.interp(grid, *zip(*knots, strict=True)), grid)

    assert all(abs(area(r["t"]) / area(1.0) - r["u"]) < 1e-6 for r in df.collect())


def test_quality(spark):
    r = random.Random(11)
    rows, labels = [], []
    for k in range(400):
        w = r.choices(WORDS, k=80)
        good = k % 5 > 0
        rows.append((k, " ".join(w if good else [x.upper() + "!!" for x in w]), "en", "s"))
        labels.append((k, int(good), 0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (999, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.weighed(documents(spark, [*rows, (800, None, "en", "s")]), lab).collect()}
    assert np.mean([got[k]["kept"] == (k % 5 > 0) for k in range(400)]) > 0.98 and got[800]["log_weight"] == 0
    assert quality.weighed(documents(spark, EDGE), lab.limit(0)).where("kept").count() == len(EDGE)
    assert quality.weighed(documents(spark, EDGE).limit(0), lab).count() == 0


def test_quality_weights_dont_depend_on_batches(spark):
    r = random.Random(3)
    ratios = np.random.default_rng(1).normal(0, 2, quality.BUCKETS)
    text = " ".join(r.choices(WORDS, k=90)).encode()
    others = [" ".join(r.choices(WORDS, k=r.randint(0, 400))).encode() for _ in range(50)]
    alone = quality.log_weights([text], ratios)[0]
    assert quality.log_weights([*others, text, b""], ratios)[-2:].tolist() == [alone, 0.0] and quality.log_weights([text, *others, text], ratios)[[0, -1]].tolist() == [alone] * 2
    rows = [(k, " ".join(r.choices(WORDS, k=r.randint(1, 60))), "en", "s") for k in range(300)]
    docs = documents(spark, rows + [(1000 + k, t, *x) for k, t, *x in rows])
    labels = spark.createDataFrame([(k, 1) for k in range(0, 300, 3)], "doc_id long, quality int")
    for k in (1, 77, 300):
        a, b = (quality.weighed(docs.repartition(n), labels, keep=keep, k=k).where("kept").select("doc_id").collect() for n, keep in ((1, True), (7, False)))
        assert len(a) == k and sorted(a) == sorted(b)


def test_quality_weight_is_the_sum_of_log_ratios(spark):
    r = random.Random(13)
    rows = [(k, " ".join(r.choices(WORDS[:60], k=r.randint(0, 30))) + r.choice(["", "!!", " a, a a"]), "en", "s") for k in range(60)]
    lab = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = {x["doc_id"]: x["log_weight"] for x in quality.weighed(documents(spark, rows), lab).collect()}

    def grams(text):
        w = re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^0-9A-Za-z_\s\x80-\U0010ffff]+", text)
        one = [int(quality.ngram_buckets([x.encode()])[0][0]) for x in w]
        two = [int(quality.REPEAT) & (quality.BUCKETS - 1) if a == b else int(quality.ngram_buckets([f"{a} {b}".encode()])[0][2]) for a, b in zip(w, w[1:], strict=False)]
        return one + two

    raw = Counter(g for _, t, *_ in rows for g in grams(t))
    target = Counter(g for k, t, *_ in rows if k % 2 and t and zlib.crc32(str(k).encode()) % 5 for g in grams(t))
    n, m = sum(target.values()), sum(raw.values())
    scale = n / m
    total = m * scale + quality.BUCKETS

    def weight(text):
        return sum(math.log((target[g] + 1) / (n + quality.BUCKETS)) - math.log((raw[g] * scale + 1) / total) for g in grams(text))

    assert all(math.isclose(got[k], weight(t), rel_tol=1e-9, abs_tol=1e-9) for k, t, *_ in rows)


def test_gumbel_top_k_follows_the_weights(spark):
    from pyspark.sql import Window

    n, k, seeds = 12, 4, 3000
    weights = [0.25 * i for i in range(n)]
    df = spark.range(n).crossJoin(spark.range(seeds).withColumnRenamed("id", "seed")).withColumnRenamed("id", "doc_id").withColumn("log_weight", F.col("doc_id") * 0.25)
    key, tie = quality._key(F.col("doc_id"), 1.0, F.col("seed"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("key"), F.desc("tie")))
    kept = df.withColumns({"key": key, "tie": tie}).withColumn("rank", rank).where(F.col("rank") <= k)
    got = {r["doc_id"]: r["n"] / seeds for r in kept.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    rng = np.random.default_rng(0)  # sampling without replacement, one after another by weight
    want = np.zeros(n)
    p = np.exp(weights) / np.exp(weights).sum()
    for _ in range(seeds):
        want[rng.choice(n, k, replace=False, p=p)] += 1 / seeds
    assert all(abs(got[i] - want[i]) < 0.05 for i in range(n))
    rows = [(i, "a" * (i % 7), "en", "s") for i in range(300)]
    lab = spark.createDataFrame([(i, int(i % 7 > 3)) for i in range(300)], "doc_id long, quality int")
    got = quality.weighed(documents(spark, rows), lab, k=100).collect()
    assert sum(r["kept"] for r in got) == 100 and min(r["log_weight"] for r in got if r["kept"]) < max(r["log_weight"] for r in got if not r["kept"])
    assert quality.weighed(documents(spark, rows), lab, k=0).where("kept").count() == 0 and quality.weighed(documents(spark, rows), lab, k=999).where("kept").count() == 300


def test_kth_key(spark):
    r = random.Random(2)
    rows = [(r.choice([0.5, r.random()]), k * 7919 % 1000003) for k in range(3000)]
    df = spark.createDataFrame(rows, "key double, tie long").cache()
    for k in (1, 700, 1500, 2999, 3000):
        key, tie = quality.kth_key(df, k, bins=16, few=8)
        assert df.where((F.col("key") > key) | ((F.col("key") == key) & (F.col("tie") >= tie))).count() == k


def test_ngram_buckets_dont_depend_on_batches(corpus):
    texts = [t.encode() for _, t, *_ in corpus[:40]] + [b"", b"a, b!! c"]
    buckets, counts = quality.ngram_buckets(texts)
    at = np.cumsum(counts)
    for k, t in enumerate(texts):
        own, n = quality.ngram_buckets([t])
        assert n[0] == counts[k] and sorted(own) == sorted(buckets[at[k] - counts[k] : at[k]])


def brute_chat(roles):
    """Least cost by Dijkstra over (turns read, state)."""
    best = {(0, 0): 0}
    todo = [(0, 0, 0)]
    while todo:
        cost, i, s = todo.pop(min(range(len(todo)), key=lambda k: todo[k][0]))
        if cost > best[i, s]:
            continue
        steps = [(cost + chat.INSERT, i, chat.ROLES.index(r) + 1) for r in chat.NEXT[s]]
        if i < len(roles):
            steps += [(cost + (0 if r == roles[i] else chat.RELABEL), i + 1, chat.ROLES.index(r) + 1) for r in chat.NEXT[s]]
            if s:
                steps.append((cost + chat.MERGE + (0 if chat.ROLES[s - 1] == roles[i] else chat.RELABEL), i + 1, s))
        for c, j, t in steps:
            if c < best.get((j, t), 1 << 40):
                best[j, t] = c
                todo.append((c, j, t))
    return min(best.get((len(roles), s), 1 << 40) for s in chat.FINAL)


def cost_of(roles, text):
    """What a rendering says was done: (cost, numbers of the turns in order, roles)."""
    cost, read, out = 0, [], []
    for role, body in re.findall(r"<\|(system|user|assistant)\|>\n(.*?)\n<\|end\|>", text, re.S):
        own = [int(x) for x in re.findall(r"t(\d+)", body)]
        cost += (len(own) - 1) * chat.MERGE if own else chat.INSERT
        cost += sum(chat.RELABEL for i in own if roles[i] != role)
        read += own
        out.append(role)
    return cost, read, out


@pytest.mark.parametrize("turns", [3, 1 << 12])
def test_chat_repair(spark, turns):
    r = random.Random(4)
    convs = {k: [r.choice(["user", "assistant", "system", "Human", None, "tool"]) for _ in range(r.randint(1, 9))] for k in range(60)}
    convs[77] = [r.choice(["user", "assistant", None]) for _ in range(300)]
    number = lambda k, i: None if k == 9 and i == 0 else i * (70_000 if k % 2 else 1)
    rows = [(k, number(k, i), role, f"t{i}") for k, roles in convs.items() for i, role in enumerate(roles)] + [(500, 0, "user", None), (None, None, "user", "x")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, cost int")
    got = {}
    for x in sorted(chat.formatted(df, turns).collect(), key=lambda x: x["part"]):
        got.setdefault(x["conv_id"], []).append(x)
    for k, roles in convs.items():
        known = [chat.role_of(x) for x in roles]
        assert got[k][0]["cost"] == brute_chat(known) and len(got[k]) == got[k][0]["parts"] == -(-len(roles) // turns)
        text = "".join(p["text"] for p in got[k])
        cost, read, out = cost_of(known, text)
        state = 0
        for role in out:
            assert role in chat.NEXT[state]
            state = chat.ROLES.index(role) + 1
        assert state in chat.FINAL and read == list(range(len(roles))) and cost == got[k][0]["cost"]
        assert [x for p in got[k] for x in p["roles"]] == out and sum(p["n_turns"] for p in got[k]) == len(roles)
    assert None in got and got[500][0]["n_out"] == 2
    assert chat.formatted(df.limit(0)).count() == 0


def test_chat_edges(spark):
    long = "x" * 3_000_000 + "<|user|>"
    rows = [(1, 1, "user", long), (1, 1, "user", long), (1, 2, "assistant", ""), (2, None, "user", "b"), (2, None, "user", "a"), (None, 3, None, "n"), (None, 3, None, "n")]
    df = spark.createDataFrame([(*x, "t") for x in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert len(got) == 3 and got[1]["cost"] == chat.MERGE and got[1]["text"].count("x") == 6_000_000 and "<|user|>" not in got[1]["text"][10:]
    assert got[2]["text"].index("a\nb") and got[None]["n_turns"] == 2 and got[None]["cost"] == brute_chat([None, None])


def test_bpe_equals_library(spark, corpus):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    texts = ["", "  \n\n x", "<|endoftext|>a<|endoftext|>", "a" * 900, "don't 'S 're", "é ²3½ ٣", "🙂🙂 x‍", "\x1c a\x85 \xa0 d", "Äß ñ " * 40, "zq" * 300, "՘a ꟎b", *(t for _, t, *_ in corpus[:40])]
    codec = bpe.Codec(bpe.vocabulary_path())
    for t, ids in zip(texts, codec.encode_many(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want and codec.decode(ids) == lib.decode(want, skip_special_tokens=False)
    for w in (b"hello", b"abcabcabc" * 30, "ñandú".encode()):
        assert codec.word(w) == codec._long([codec.first[b] for b in w])
    got = bpe.encoded(documents(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and min(r["n_tokens"] for r in got) == 0
    assert bpe.encoded(documents(spark, EDGE).limit(0)).count() == 0


def slow_resize(x, height, width):
    """Area means by loops over samples."""
    h, w = x.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            for y in range(h):
                for k in range(w):
                    out[i, j] += x[y, k] * max(0.0, min(y + 1, y1) - max(y, y0)) * max(0.0, min(k + 1, x1) - max(k, x0))
            out[i, j] /= (y1 - y0) * (x1 - x0)
    return out


def slow_features(x, top=255):
    """(difference hash, tile samples) by loops."""
    small = np.rint(slow_resize(x, 8, 9) * 256)
    bits = "".join(str(int(small[i, j + 1] > small[i, j])) for i in range(8) for j in range(8))
    return f"{int(bits, 2):016x}", np.clip(np.rint(slow_resize(x, 32, 32) * 255 / top), 0, 255)


def test_images_round_trip(monkeypatch):
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (13, 21), dtype=np.uint8)
    assert (media.decode_image(media.encode_pgm(x)) == x).all() and (media.decode_image(media.encode_bmp(x)) == x).all()
    assert media.decode_image(b"P3\n# c\n2 1\n255\n1 2 3  4 5 6\n").tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode_image(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]] and media.decode_image(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    for bad in (b"P5\n9 9\n255\nxx", b"P5 0 0 255\n", b"P5\n1 1\n0\n\0", b"P2 1 1 15 16", b"P5 1 1 70000\n00", b"P1 0 3\n", b"BM" + b"\0" * 60, b"", b"P5"):
        with pytest.raises((ValueError, IndexError)):
            media.decode_image(bad)
    big = np.kron(x, np.ones((4, 6)))
    for strip in (1, 100, 1 << 19):
        monkeypatch.setattr(media, "STRIP", strip)
        assert np.allclose(media.area_resize(big.astype(np.uint8), 13, 21), x)
        for size in ((5, 4), (8, 9), (32, 32), (1, 1)):
            assert np.allclose(media.area_resize(x, *size), slow_resize(x, *size))
        code, tile = media.features_of(x)
        want = slow_features(x)
        assert code == want[0] and (np.load(io.BytesIO(tile)) == want[1]).all()


def test_levels_of_images(spark):
    white, ramp = b"P2 2 2 15\n" + b"15 " * 4, b"P5 64 1 65535\n" + (np.arange(64) * 1040).astype(">u2").tobytes()
    images = spark.createDataFrame([(1, bytearray(media.encode_pgm(np.zeros((9, 9), dtype=np.uint8)))), (2, None), (3, bytearray(b"junk")), (4, bytearray(white)), (5, bytearray(ramp)), (6, bytearray(b"P5 0 0 255\n"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_features(images).collect()}
    assert [got[k]["feature"] is None for k in range(1, 7)] == [False, True, True, False, False, True]
    assert (np.load(io.BytesIO(got[4]["tile"])) == 255).all()
    line = np.load(io.BytesIO(got[5]["tile"]))[0].astype(int)
    assert line[0] == 2 and line[-1] == 253 and (np.diff(line) > 0).all()


def test_text_media(spark):
    rows = [*EDGE, (9, "é" * 64, "en", "a"), (10, "a" * 65, "en", "a"), (11, "long " * 700_000, "en", "a")]
    for form in (None, "pgm", "bmp"):
        for r, (_, t, *_) in zip(media.text_media(documents(spark, rows).coalesce(1), form).collect(), rows, strict=True):
            raw = (t or "").encode()
            padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            image = media.stored_form(padded, form)
            assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
            if len(padded) < 4000:
                want = slow_features(np.frombuffer(padded, dtype=np.uint8).reshape(-1, 64))
                assert r["feature"] == want[0] and (np.load(io.BytesIO(r["tile"])) == want[1]).all()
    forms = {media.stored_form(media.payload_of(t.encode()))[:2] for t in "abcdefgh"}
    assert forms == {b"P5", b"BM"}
    assert media.text_media(documents(spark, EDGE).limit(0)).count() == 0


def records(archives, index, df):
    return warc.read_records(archives, warc.captures_of(index, warc.directory_of(index), warc.keys_of(df)))


def test_warc(spark):
    pages = [(1, "http://user@www.Example.com:80/a?b=1#c", "<p>x</p>"), (2, "https://b.org", "<p>x</p>"), (5, None, None), (4, "http://b.org/ü x", ""), (3, "https://b.org", "only"), (None, "http://n.org", "only"), (None, "http://n.org", "only"), (None, None, "only")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    archives = warc.write_archives(df)
    index = warc.build_index(archives)
    rows = records(archives, index, df).collect()
    got = {r["page_id"]: r for r in rows}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4), 3: ("response", None), None: ("response", None)}
    assert len(rows) == len(pages)
    assert got[2]["payload_bytes"] == 8 and got[2]["payload_digest"] == got[1]["payload_digest"]
    assert warc.url_key("http://user@www.Example.com:80/a?b=1#c") == "com,example,www)/a?b=1"
    found = warc.look_up(archives, index, warc.directory_of(index), ["http://b.org/", "http://nowhere.net", "http://b.org"]).collect()
    assert sorted(r["page_id"] for r in found) == [2, 3]
    assert {bytes(r["payload"]) for r in found if r["payload"] is not None} == {b"only"}
    name = archives.where("data IS NOT NULL").first()["archive"]
    assert zlib.decompress(b"".join(warc.export_archive(archives, name)), 31).startswith(b"WARC/1.0")
    large = warc.write_archives(df, min_bytes=9)
    assert {r["record_type"] for r in records(large, warc.build_index(large), df).collect()} == {"response"}
    empty = warc.write_archives(df.limit(0))
    assert records(empty, warc.build_index(empty), df.limit(0)).count() == 0


def test_warc_repeats_and_long_pages(spark):
    long = "<p>" + "ü" * 3_000_000
    pages = [(7, "http://a.org", long), (7, "http://a.org", long), (8, "http://a.org", long), (9, "http://b.org", "x"), (9, "http://b.org", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    archives = warc.write_archives(df)
    rows = sorted(tuple(r)[:2] + (r["record_type"], r["refers_to"]) for r in records(archives, warc.build_index(archives), df).collect())
    n = len(long.encode())
    assert rows == [(7, n, "response", None), (7, n, "response", None), (8, n, "revisit", 7), (9, 1, "response", None), (9, 1, "response", None)]


def test_index_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    df = spark.createDataFrame([(k, f"http://h{k % 4}.org/{k % 5}", f"p{k}") for k in range(60)], "page_id long, url string, html string")
    archives = warc.write_archives(df)
    index = warc.build_index(archives)
    directory = warc.directory_of(index)
    assert directory.count() >= 20
    for u in ("http://h1.org/1", "http://h3.org/0", "http://h9.org/"):
        want = sorted(k for k in range(60) if f"http://h{k % 4}.org/{k % 5}" == u)
        assert sorted(r["page_id"] for r in warc.look_up(archives, index, directory, [u]).collect()) == want
    one = directory.first()
    gone = ~((F.col("part") == one["part"]) & (F.col("block") == one["block"]))
    keys = warc.keys_of(df)
    assert warc.captures_of(index, directory, keys).count() == 60
    assert warc.captures_of(index, directory.where(gone), keys).count() == 57
    with pytest.raises(Exception, match="lacks a block"):
        warc.captures_of(index.where(gone), directory, keys).count()


def test_shingles_match_python(corpus):
    texts = [t for _, t, *_ in corpus] + ["", "one", "a\x0bb\x1fc d e f g", "ÀB c d E f"]
    sets = shingles.shingle_sets([t.encode() for t in texts])
    names = {}
    for t, s in zip(texts, sets, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        own = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
        assert len(own) == len(s)
        names.setdefault(frozenset(own), set()).add(s.tobytes())
    assert all(len(v) == 1 for v in names.values())
