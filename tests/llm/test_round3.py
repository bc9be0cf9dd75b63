"""Positional index, Merkle manifest and spelling index against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tilewright.llm import merkle, phrases, spelling

LOW, HIGH = -(1 << 63), (1 << 63) - 1
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (3, "one three"), (None, "one two"), (None, None), (LOW, "w1 " * 40), (HIGH, "x" * 30_000), (6, " \n\t "), (0, "one two")]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, rows):
    """With columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, word string, pos int, n int")


def hits(rows, items):
    out = []
    grams = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lower(t))
        k = min(len(w), 10)
        for s in range(max(len(w) - 9, 1) if w else 0):
            grams[tuple(w[s : s + k])].add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    for i, t in rows:
        w = WORD.findall(lower(t))
        at, named = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in grams:
                    at.update(range(p, p + k))
                    named |= grams[g]
        out.append((i, len(w), len(at), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(at)))
    return out


def near_items(rows, items, span):
    """Items whose window has its three rarest distinct terms within span of the rarest one."""
    places = [defaultdict(list) for _ in rows]
    for d, (_, t) in zip(places, rows, strict=True):
        for p, w in enumerate(WORD.findall(lower(t))):
            d[w].append(p)
    counts = Counter()
    for _, t in {(i, t or "") for i, t in rows}:  # the index has a document once
        counts.update(WORD.findall(lower(t)))
    out = [set() for _ in rows]
    for item, t in items:
        w = WORD.findall(lower(t))
        for s in range(max(len(w) - 9, 1) if w else 0):
            terms = sorted(set(w[s : s + 10]), key=lambda x: (counts[x], x))
            if counts[terms[0]]:
                for d, named in zip(places, out, strict=True):
                    if any(all(any(abs(p - q) <= span for q in d[x]) for x in terms[1:3]) for p in d[terms[0]]):
                        named.add("" if item is None else str(item))
    return [len(x) for x in out]


@pytest.mark.parametrize("words", [3, 40, 400])
def test_phrases_brute_force(spark, words):
    r = random.Random(words)
    vocabulary = [f"w{k}" for k in range(words)]
    items = [(k % 25, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 9, 10, 11, 14, 30])))) for k in range(30)]
    items += [(None, items[3][1]), (90, None), (91, ""), (92, "..."), (93, items[4][1].upper() + "!"), (94, "nowhere " + items[5][1]), (95, "nowhere")]
    rows = list(EDGE)
    for k in range(60):
        w = r.choices(vocabulary, k=r.randint(0, 60))
        if k % 2:
            own = items[r.randrange(30)][1].split()
            own = own[r.randrange(len(own)) :] if k % 3 else own
            if k % 5 == 0 and len(own) > 3:
                own[1], own[2] = own[2], own[1]
            at = r.randint(0, len(w))
            w[at:at] = own
        rows.append((100 + k, ", ".join(w)))
    rows += [(500, rows[-1][1])] * 3 + [(501 + k, rows[-2][1]) for k in range(5)]
    bench = spark.createDataFrame([(i, t, "a", 1) for i, t in items], "item_id long, text string, term string, doc int")
    got = phrases.decontaminate(documents(spark, rows), bench).collect()
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")
    assert sorted((tuple(g[c] for c in columns) for g in got), key=key) == sorted(((*h, n) for h, n in zip(hits(rows, items), near_items(rows, items, phrases.SPAN), strict=True)), key=key)


def test_phrases_without_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BROADCAST_ROWS", 0)  # the way beyond the bound
    docs = documents(spark, [*EDGE, (9, "a b c d e f g h i j k l")])
    bench = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_hit"] for r in phrases.decontaminate(docs, bench).collect()}
    assert got[(9, 12)] == 10 and sum(got.values()) == 10
    assert phrases.decontaminate(docs.limit(0), bench).count() == 0
    empty = phrases.decontaminate(docs, bench.limit(0)).collect()
    assert len(empty) == len(EDGE) + 1 and not any(r["contaminated"] or r["n_near"] for r in empty)


def test_phrases_stay_native(spark, tmp_path):
    docs = documents(spark, EDGE)
    plan = phrases.decontaminate(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fields(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def raised(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def manifests(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows, by rebuilding every tree whole."""
    trees = defaultdict(list)
    for doc_id, source, lang, n, text in rows:
        trees[source].append((doc_id, fields(doc_id, source, lang, n, text), fields(doc_id, source, lang, n, None if text is None else text.replace("\n", ""))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    levels = {s: raised([x[1] for x in trees[s]]) for s in order}
    top = raised([levels[s][-1][0] for s in order])

    def siblings(ls, i):
        out = []
        for level in ls[:-1]:
            run = level[i - i % 3 : i - i % 3 + 3]
            out += run[: i % 3] + run[i % 3 + 1 :]
            i //= 3
        return out

    for k, s in enumerate(order):
        for i, (doc_id, leaf, changed) in enumerate(trees[s]):
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            nodes = [x[1] for x in trees[s]]
            nodes[i] = changed if tampered else leaf
            subroots = [levels[x][-1][0] for x in order]
            subroots[k] = raised(nodes)[-1][0]
            folded = raised(subroots)[-1][0]
            yield doc_id, leaf, levels[s][-1][0], top[-1][0], digest("".join(siblings(levels[s], i) + siblings(top, k))), folded, folded == top[-1][0]


@pytest.mark.parametrize(("depth", "sources"), [(6, 3), (1, 12), (2, 1)])
def test_manifest_brute_force(spark, monkeypatch, depth, sources):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "SIZE", 3**depth)
    r = random.Random(depth)
    rows = [(k * 7 - 50, None if k % 9 == 0 and sources > 1 else f"s{min(r.randrange(2 * sources), sources - 1)}é", r.choice(["en", None, ""]), r.choice([k, None]), r.choice(["a\nb", "ab", "", None, "é\n\n" * k])) for k in range(90)]
    rows += [rows[5]] * 4 + [(None, rows[7][1], "x", 1, "t\n")] * 2 + [(LOW, "z", None, None, "\n"), (HIGH, "z", None, None, "\n"), (rows[3][0], rows[3][1], "other", 1, "x\ny")]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, at int")
    got = merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(manifests(rows), key=key)
    assert any(x["verified"] for x in got) and not all(x["verified"] for x in got)


def test_manifest_without_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.manifest(df.limit(0)).count() == 0
    one = merkle.manifest(df).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["depth"] == 0 and one["proof_sha256"] == digest("")


def test_versions_share_untouched_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "SIZE", 9)
    df = spark.createDataFrame([(k, "s", "en", k, f"a\n{k}") for k in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    forest = merkle.forest_of(df)
    base = raised([fields(k, "s", "en", k, f"a\n{k}") for k in range(100)])
    got = {(r["level"], r["at"]): r["hash"] for r in forest.nodes().collect()}
    assert got == {(k, i): h for k, level in enumerate(base) for i, h in enumerate(level)}
    copied = defaultdict(dict)
    for r in forest.versions().collect():
        copied[r["version"]][(r["level"], r["at"])] = r["hash"]
    assert set(copied) == {k for k in range(100) if zlib.crc32(str(k).encode()) % 2 == 0}
    for k, own in copied.items():
        assert set(own) == {(n, k // 3**n) for n in range(len(base))}  # a path and nothing else
    k = min(copied)
    changed = [x if i != k else fields(k, "s", "en", k, f"a{k}") for i, x in enumerate(base[0])]
    at = {(r["level"], r["at"]): r["hash"] for r in forest.nodes_at("=s", k).collect()}
    assert at == {(n, i): h for n, level in enumerate(raised(changed)) for i, h in enumerate(level)}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def variants(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n, len(near[w]), words.get(form[w])


@pytest.mark.parametrize("letters", [1 << 16, 100])
def test_spelling_brute_force(spark, monkeypatch, letters):
    monkeypatch.setattr(spelling, "LETTERS", letters)
    r = random.Random(4)
    base = ["".join(r.choices("abéÿ", k=r.randint(6, 9))) for _ in range(12)] + ["prefix" + "".join(r.choices("ab", k=3)) for _ in range(12)] + ["z" * n for n in (62, 63, 64, 65, 126, 127, 128, 129, 300, 301)]
    words = []
    for w in base:
        for times in (150, 25, 5):
            words += [w] * times
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÿ") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])
    r.shuffle(words)
    rows = [(k, " ".join(words[i : i + 40])) for k, i in enumerate(range(0, len(words), 40))]
    rows += [*EDGE, (None, "Übermut ÜBERMUT übermut-übermut"), (77, "straßen" * 900)] + [(5, "repeated row and words")] * 6
    got = spelling.spelling_variants(documents(spark, rows)).collect()
    want = sorted(variants(rows), key=str)
    assert sorted((tuple(g[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for g in got), key=str) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] != w[1] is not None for w in want)
    assert spelling.spelling_variants(documents(spark, rows).limit(0)).count() == 0


def test_position_index_finds_all_words_one_edit_apart():
    r = random.Random(8)
    words = sorted({"".join(r.choices("abc", k=r.randint(6, 8))) for _ in range(700)})
    index = spelling.PositionIndex(words, 9)
    got = set()
    for n in (5, 6, 7, 8, 9):
        queries = [w for w in {*words, *("".join(r.choices("abcd", k=n)) for _ in range(50))} if len(w) == n]
        q, w = index.near(queries)
        assert {(queries[a], words[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True)} == {(a, b) for a in queries for b in words if one_apart(a, b)}
        got.update(zip(q.tolist(), w.tolist(), strict=True))
    assert got


def test_noise_is_rare_and_ends_settle(spark):
    links = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(23)], "word string, root string")
    assert {r["root"] for r in spelling.ends(links).collect()} == {"w23"}
    assert spelling.ends(links.limit(0)).count() == 0
    assert list(itertools.islice(variants([]), 1)) == [] and F is not None
