import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from compare import difference
from conftest_llm import CLASHES, documents

from tabularium.llm import queries, spelling, sql

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    forms, out = {}, {}
    for w, n in words.items():
        around = [x for x in words if near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out[w] = n, len(around)
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (w, forms[w], root, *out[w], words.get(forms[w]))
    return set(out.values())


def fixture(seed=8):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeéßÿ", k=rng.randrange(7, 11))) for _ in range(25)]
    pool = Counter()
    for s in stems:
        pool[s] += rng.choice([3, 40, 900])
        for _ in range(12):
            i, kind = rng.randrange(len(s)), rng.randrange(3)
            pool[s[:i] + rng.choice("abÿzZ") * (kind > 0) + s[i + (kind != 1) :]] += rng.choice([1, 2, 3, 30])
    pool += Counter({"zyxwvut": 3, "zyxwvuts": 60, "zyxwvutsr": 900})
    tokens = list(pool.elements())
    rng.shuffle(tokens)
    rows = [(i, " ".join(x if rng.random() < 0.9 else x.capitalize() for x in tokens[i::400]) + rng.choice([".", "!\n", "9", ""])) for i in range(400)]
    return rows + [(None, "aaaaaaa aaaaaaaa aaaaaaaaa baaaaaaa"), (None, "aaaaaaa aaaaaaaa aaaaaaaaa baaaaaaa"), (900, None), (901, ""), (902, "short words only"), rows[3], rows[3], (903, "aaaaaaaaab " * 30_000)]


def test_same_as_all_pairs(spark):
    rows = fixture()
    docs = documents(spark, rows, CLASHES).repartition(5)
    got = spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = plain(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r["form"] and r["root"] != r["form"] for r in got), "no chain is longer than one step"


def test_a_full_filter_changes_nothing(spark):
    """What a filter lets through by chance finds no partner: one of few bits a word gives the same rows."""
    words = spelling.cut(spelling.vocabulary(documents(spark, fixture(5))), "vocabulary")
    exact = {(r["near"], r["word"]) for r in spelling.candidates(words).join(words.select(words["word"].alias("near")), "near").collect()}
    loose = spelling.candidates(words, most_bits=10)
    assert loose.count() > len(exact)
    assert {(r["near"], r["word"]) for r in loose.join(words.select(words["word"].alias("near")), "near").collect()} == exact


def test_edits_are_all_distinct_ones():
    letters = "abé"
    for word in ("aabbéa", "aaaa", "abéabé"):
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[j:] for i in range(len(word) + 1) for c in letters for j in {i, min(i + 1, len(word))}}
        want.discard(word)
        points = np.array([[ord(c) for c in word]], np.uint32)
        got, hashed = [], []
        for kind, i, h, skip in spelling.edits(points, np.array([ord(c) for c in letters], np.uint32)):
            for x in np.flatnonzero(~skip[0]).tolist():
                made = word[:i] + ("" if kind == "delete" else letters[x]) + word[i + (kind != "insert") :]
                got.append(made)
                hashed.append((made, int(h[0, x])))
        assert len(got) == len(set(got)) and set(got) == want
        for made, h in hashed:
            assert int(spelling.hashes(np.array([[ord(c) for c in made]], np.uint32))[0]) == h


def test_tables_without_words(spark, odd_rows):
    assert spelling.variants(documents(spark, [])).collect() == []
    assert spelling.variants(documents(spark, [(1, None), (2, "few")])).collect() == []
    assert {tuple(r) for r in spelling.variants(documents(spark, odd_rows)).collect()} == plain([r[:2] for r in odd_rows])


def test_same_as_sql(spark, data):
    assert difference(spark, queries.op13_spelling_variants, sql.SPELLING, data) == ""
