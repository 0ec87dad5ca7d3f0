import random
import re

import numpy as np
import pyarrow as pa
from conftest_llm import CLASHES, documents

from tabularium.llm import minhash
from tabularium.llm.components import components
from tabularium.llm.textcore import shingles, slices, word_hashes




def brute(rows, percent=75):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        group = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        least = None if r[0] is None else min(group)
        out.append((r[0], len(sets[i]), least, r[0] is None or r[0] == least))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def near_copies(seed, groups, most, words=120):
    """Groups of texts with a few words changed: similarities on both sides of the limit."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rng.shuffle(rows)
    return rows


def test_same_as_brute_force(spark):
    rows = near_copies(1, 12, 14) + [(1000 + i, "the same short text") for i in range(20)]
    assert found(minhash.near_duplicates(documents(spark, rows))) == brute(rows)


def test_large_group_in_blocks(spark):
    rows = near_copies(2, 2, 120, 60)
    assert found(minhash.near_duplicates(documents(spark, rows), block=16, broadcast_rows=0)) == brute(rows)


def test_odd_rows_and_clashing_columns(spark, odd_rows):
    assert found(minhash.near_duplicates(documents(spark, odd_rows, CLASHES))) == brute(odd_rows)


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (3, "a b c d e f g")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got[2] == 1 and got[3] == 1


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (102, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    both, one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.sort(np.concatenate(x)) for x in ((both, one), (both, two))]
    sig = minhash.signature(np.concatenate(sets), np.array([0, 800, 1600]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


def test_hashes_follow_words_only():
    texts = ["A  b\tc d e f", "a b c d E f", "a b c d e", "ab c d e f", "", None]
    (a, b, data, offsets), = slices(pa.array(texts))
    sets, at = shingles(*word_hashes(data, offsets))
    rows = [set(sets[at[i] : at[i + 1]].tolist()) for i in range(6)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 and rows[2] < rows[0]
    assert not rows[3] & rows[0] and rows[4] == rows[5] == set()
