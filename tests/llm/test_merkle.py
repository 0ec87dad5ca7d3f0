import hashlib
import random
import zlib

import pytest
from compare import difference
from conftest_llm import CLASHES, documents
from pyspark.sql import functions as F

from tabularium.llm import merkle, queries, sql


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(nodes, group):
    """All levels of a list of digests."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + group]) for i in range(0, len(levels[-1]), group)])
    return levels


def siblings(levels, i, group):
    """(digests before, after) at each level."""
    for nodes in levels[:-1]:
        a = i // group * group
        yield nodes[a:i], nodes[i + 1 : a + group]
        i //= group


def plain(rows, group=2):
    """rows: doc_id, text, lang, source, n_chars -> what the query returns."""
    by_lang = {}
    for d, text, lang, source, n in rows:
        leaf = lambda n, d=d, text=text, lang=lang, source=source: H(*map(field, (d, source, lang, n, text)))
        chosen = d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        by_lang.setdefault(lang, []).append(((d is not None, d or 0), leaf(n), leaf(n + 1) if chosen and n is not None else leaf(n), d))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:2])
        trees.append(up([x[1] for x in by_lang[lang]], group))
    whole = up([t[-1][0] for t in trees], group)
    out = []
    for k, (lang, levels) in enumerate(zip(langs, trees, strict=True)):
        for i, (_, leaf, tampered, d) in enumerate(by_lang[lang]):
            own, proof = tampered, ""
            for before, after in [*siblings(levels, i, group), *siblings(whole, k, group)]:
                own, proof = H(*before, own, *after), proof + "".join(before + after)
            out.append((d, leaf, levels[-1][0], whole[-1][0], H(proof), own, own == whole[-1][0]))
    return out


def fixture(n=300, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["text", "", None, "é" * 50]), rng.choice(["en"] * 12 + ["de", "fr", "", None, "zz"]), rng.choice(["s", None, ""]), rng.choice([None, 3, 50])) for i in range(n)]
    rows += [(None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (5, "twice", "en", "s", 1), rows[5], rows[5], (9**15, "alone", "one", "s", 5), (-3, "x " * 50_000, "en", "s", 1)]
    return rows


def table(spark, rows, extra=()):
    docs = documents(spark, [], extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], docs.schema)


def same(got, want):
    key = lambda x: tuple(map(str, x))
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("group", [2, 3])
def test_same_as_a_plain_tree(spark, group):
    rows = fixture()
    want = plain(rows, group)
    assert same(merkle.verified(table(spark, rows, CLASHES).repartition(3), group).collect(), want)
    assert {x[-1] for x in want} == {True, False}


def test_a_tree_of_many_rounds(spark):
    """5,000 leaves are three rounds of blocks of 64; every level's nodes are there once."""
    n = 5000
    leaves = spark.range(n).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("index"), F.lit(n).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    tree = merkle.Trees(leaves)
    levels = up([H(str(i)) for i in range(n)], 2)
    got = {(r["level"], r["index"]): r["hash"] for r in tree.nodes.collect()}
    assert got == {(k, i): h for k, nodes in enumerate(levels) for i, h in enumerate(nodes)}
    assert tree.tops.collect() == [(0, levels[-1][0])]
    asked = {r["index"]: [x["hash"].hex() for x in r["path"]] for r in tree.proofs().where("index in (0, 63, 4095, 4096, 4999)").collect()}
    assert asked == {i: [h for b, a in siblings(levels, i, 2) for h in b + a] for i in (0, 63, 4095, 4096, 4999)}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65])
def test_small_tables(spark, n):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(n)]
    assert same(merkle.verified(table(spark, rows)).collect(), plain(rows))


def test_empty_table(spark):
    assert merkle.verified(table(spark, [])).collect() == []


def test_same_as_sql(spark, data):
    assert difference(spark, queries.op12_merkle_proofs, sql.MERKLE, data) == ""
