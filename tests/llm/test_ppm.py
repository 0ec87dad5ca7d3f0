import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest_llm import CLASHES, documents

from tabularium.llm import ppm

ORDER = 6


def normal(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, "".join(x + " " for x in w).encode() + b"\n"


def held(i, modulus=10):
    return zlib.crc32(b"" if i is None else str(i).encode()) % modulus == 0


def brute(rows, order=ORDER):
    """Escape method D with exclusion, straight from dictionaries of counters."""
    trie, words = [defaultdict(Counter) for _ in range(order + 1)], Counter()
    for i, text in rows:
        if not held(i):
            w, raw = normal(text)
            words.update([*w, "\n"])
            raw = b"\n" * order + raw
            for p in range(order, len(raw)):
                for k in range(order + 1):
                    trie[k][raw[p - k : p]][raw[p]] += 1
    n, v, out = sum(words.values()), len(words), []
    for i, text in rows:
        w, raw = normal(text)
        raw, score = b"\n" * order + raw, 0.0
        for p in range(order, len(raw)):
            gone = set()
            for k in range(order, -1, -1):
                seen = trie[k].get(raw[p - k : p])
                if not seen:
                    continue
                left = {s: c for s, c in seen.items() if s not in gone}
                total = 2 * sum(left.values())
                if raw[p] in left:
                    score += math.log10((2 * left[raw[p]] - 1) / total)
                    break
                if left:
                    score += math.log10(len(left) / total)
                gone |= set(seen)
            else:
                score -= math.log10(256 - len(gone))
        tokens = [*w, "\n"]
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        out.append((i, held(i), len(tokens), sum(x in words for x in tokens), n, base, score))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-5)


ROWS = [(i, " ".join(f"{'abcdef'[i * j % 6] * (j % 3 + 1)}{'the of and to'.split()[(i + j) % 4]}" for j in range(i % 17)) + " The END" * (i % 3)) for i in range(60)]


def test_same_as_brute_force(spark):
    same([tuple(r) for r in ppm.score(documents(spark, ROWS)).collect()], brute(ROWS))


def test_rare_words_by_the_join(spark):
    same([tuple(r) for r in ppm.score(documents(spark, ROWS), most_words=5).collect()], brute(ROWS))


def test_odd_rows(spark, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + ROWS[:20]
    got = ppm.score(documents(spark, rows, CLASHES))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same([tuple(r) for r in got.collect()], brute(rows))


@pytest.mark.parametrize("most", [0, 1, 200, 1500])
def test_rare_contexts_by_the_joins(spark, odd_rows, most):
    rows = [(r[0], r[1]) for r in odd_rows] + ROWS + [(i, f"unseen {i} zq~{i * i}") for i in range(100, 130)]
    same([tuple(r) for r in ppm.score(documents(spark, rows), most_entries=most).collect()], brute(rows))


def test_probabilities_of_next_bytes_add_up():
    import numpy as np

    trie = ppm.Trie([(np.array([97, 98, 32, 10], np.uint64), np.array([3, 2, 2, 1])), (np.array([97 << 8 | 98, 97 << 8 | 32, 32 << 8 | 97, 98 << 8 | 97], np.uint64), np.array([2, 1, 1, 1]))])
    for context in (97, 98, 32, 10, 120):
        code = np.array([context << 8 | s for s in range(256)], np.uint64)
        assert (10 ** -trie.code_length(code)).sum() == pytest.approx(1, abs=1e-6)


def test_no_rows_to_learn_from(spark):
    assert ppm.score(documents(spark, [])).collect() == []
    alone = next(i for i in range(1000) if held(i))
    row = ppm.score(documents(spark, [(alone, "ab")])).collect()[0]
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == pytest.approx(-4 * math.log10(256), rel=1e-6)
