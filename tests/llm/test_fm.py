import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import CLASHES, documents

from tabularium.llm import fm
from tabularium.llm.textcore import slices


def corpus(n=900, seed=3):
    """Class 1: 'blorg' and 'fnar' together; either alone is harmless."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 60))]
        kind = rng.randrange(4)
        w += ["blorg"] * (kind in (1, 3)) + ["Fnar!"] * (kind in (2, 3))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind == 3)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_an_interaction(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in fm.score(docs, fm.train(docs, frame(spark, labels), bits=16)).collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.95 * len(held)


def test_learns_a_pair_whose_terms_tell_nothing_alone(spark):
    rng, rows, labels = random.Random(4), [], []
    for i in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randrange(300)}" for _ in range(30)] + ["blorg"] * a + ["fnar"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(a != b)))
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["predicted"] for r in fm.score(docs, fm.train(docs, frame(spark, labels))).where("held_out").collect()}
    assert sum(got[i] == y for i, _, y in labels if i in got) >= 0.98 * len(got)


def plain_score(text, model):
    """The machine's sum over all pairs, term by term."""
    words = {w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()) if w}
    (_, _, data, offsets), = slices(pa.array([" ".join(sorted(words))]))
    mine = set(fm.terms(data, offsets, model["bits"])[0].tolist())
    at = [i for i, p in enumerate(model["places"].tolist()) if p in mine]
    z = model["b"] + sum(model["w"][i] for i in at)
    z += sum(float(model["v"][i] @ model["v"][j]) for i in at for j in at if i < j)
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_a_plain_sum_over_pairs(spark, odd_rows):
    rows, labels = corpus(600)
    texts = [r for r in odd_rows if r[1] and r[1].isascii()] + rows[:60]
    docs = documents(spark, rows)
    model = fm.train(docs, frame(spark, labels), bits=16)
    got = fm.score(documents(spark, texts), model).collect()
    want = sorted(plain_score(r[1], model) for r in texts)
    assert sorted(r["score"] for r in got) == pytest.approx(want, abs=1e-9)


def test_held_out_labels_are_never_read(spark):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    other = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    one, two = (fm.train(docs, frame(spark, x), bits=14) for x in (labels, other))
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_odd_rows_empty_and_one_class(spark, odd_rows):
    docs = documents(spark, odd_rows, CLASHES)
    none = fm.train(docs, frame(spark, []))
    scored = fm.score(docs, none).collect()
    assert len(scored) == len(odd_rows) and {r["predicted"] for r in scored} == {0}
    some = fm.train(docs, frame(spark, [(4, 1, 0), (8, 1, 0), (None, 1, 1), (5, 1, None)]))
    assert fm.score(docs, some).where("score < 0 or score > 1 or score is null").count() == 0
    assert fm.accepted(docs, some).columns == docs.columns and fm.accepted(docs, some).count() == len(odd_rows)
    assert fm.score(documents(spark, []), none).collect() == []


def test_terms_of_a_row():
    (_, _, data, offsets), = slices(pa.array(["Idiot! idiot idiotic", "idiot", "", "..."]))
    found, at = fm.terms(data, offsets, 20)
    rows = [set(found[at[i] : at[i + 1]].tolist()) for i in range(4)]
    assert rows[1] < rows[0] and rows[2] == rows[3] == set() and len(rows[1]) == 3
