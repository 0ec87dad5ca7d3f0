import math
import random
import re
import struct
from collections import Counter, defaultdict

import xxhash
from conftest_llm import CLASHES, documents

from tabularium.llm import mixing

W = re.compile(r"[^\x20\x09-\x0D]+")


def fixture(seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(rng.choice([0, 1, 3, 200, 700]))), rng.choice(["big"] * 6 + ["mid", "mid", "tiny", "other", None])) for i in range(400)]
    return rows + [(1000, "only a few words here", "zz"), (1001, None, "none"), (None, "x y z " * 90, "mid"), rows[5], rows[5]]


def water_fill(sizes):
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        rest, all_ = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / all_ > 3 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / all_ for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_what_is_taken(spark):
    rows = fixture()
    docs = documents(spark, rows, CLASHES)
    got = mixing.Mix(docs, block=16).taken().collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(W.findall(text or ""))
    want = water_fill(dict(sizes))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), len(W.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    assert set(by_target) == {(sizes[s], round(t, 6)) for s, t in want.items()}
    for (size, target), taken in by_target.items():
        assert abs(taken - target) <= max(0.03 * target, 3 * 16), (size, target, taken)


def spark_hash(*values):
    """Spark's xxhash64 of longs, ints and strings."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def permuted(x, n, side, *key):
    while True:
        left, right = divmod(x, side)
        for r in range(4):
            left, right = right, (left + spark_hash(*key, r, (right,)) % side) % side
        x = left * side + right
        if x < n:
            return x


def test_a_plain_replay_takes_the_same(spark):
    rows = [r for r in fixture(5) if r[0] is not None][:-2]
    docs = documents(spark, rows)
    mix = mixing.Mix(docs, block=16, shard=64)
    got = {r["doc_id"]: r["taken"] for r in mix.taken().collect()}
    words = {r[0]: len(W.findall(r[1] or "")) for r in rows}
    of = {r[0]: (r[2] if len(r) > 2 else "s") for r in rows}
    sizes = defaultdict(int)
    for i, s in of.items():
        sizes[s] += words[i]
    want, taken, shards = water_fill(dict(sizes)), Counter(), Counter()
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    slots = {s: min(math.floor(want[s] * -(-sizes[s] // 16) / sizes[s] + 0.5), 3 * -(-sizes[s] // 16)) if sizes[s] else 0 for s in names}
    total, light = sum(slots.values()), min(n for n in slots.values() if n)
    shards_ = -(-total // 64)
    drawn = shards_ - math.ceil(shards_ * min(0.5, max(1 / 16, 3 / math.sqrt(light))))
    assert drawn == mix.drawn and drawn >= 8
    owner = [s for s in names for _ in range(slots[s])]
    used, blocks = Counter(), {s: -(-sizes[s] // 16) for s in names}
    stream = {s: [i for i in sorted((i for i in of if of[i] == s), key=lambda i: spark_hash_doc(i, rows) % 2**64) for _ in range(words[i])] for s in names}

    def take(shard, s, slot):
        epoch, at = divmod(slot, blocks[s])
        b = permuted(at, blocks[s], math.isqrt(blocks[s] - 1) + 1, 1, (names.index(s),), epoch)
        taken.update(stream[s][16 * b : 16 * b + 16])
        shards[shard, names.index(s)] += 1

    for k in range(drawn):
        for s, n in Counter(owner[spark_hash(1, "draw", (k,), (at,)) % total] for at in range(64)).items():
            for _ in range(min(n, slots[s] - used[s])):
                take(k, s, used[s])
                used[s] += 1
    assert {(r["shard"], r["number"]): r["count"] for r in mix.draws.collect()} == dict(shards)
    rest = {s: slots[s] - used[s] for s in names}
    left, low = sum(rest.values()), 0
    for s in names:
        for x in range(rest[s]):
            take(drawn + permuted(low + x, left, math.isqrt(left - 1) + 1, 1, "place") // 64, s, used[s] + x)
        low += rest[s]
    assert got == {i: taken[i] for i in words}
    assert {(r["shard"], r["number"]): r["count"] for r in mix.counts().collect()} == dict(shards)


def spark_hash_doc(i, rows):
    text = next(r[1] for r in rows if r[0] == i)
    return spark_hash(1, (i,)) if text is None else spark_hash(1, (i,), text)


def test_shards_are_drawn_by_target(spark, data):
    """16 shards or more on the small tables; their counts differ from shard to shard as multinomial ones do, and all together meet the targets."""
    from pyspark.sql import functions as F

    mix = mixing.Mix(spark.read.parquet(f"{data}/documents.parquet"))
    counts = mix.counts().collect()
    shards = {r["shard"] for r in counts}
    assert len(shards) >= 16 and mix.drawn >= 8
    total = sum(r["count"] for r in counts)
    by_source = Counter()
    for r in counts:
        by_source[r["number"]] += r["count"]
    drawn = {(r["shard"], r["number"]): r["count"] for r in mix.draws.collect()}
    spread = sum((drawn.get((k, s), 0) - mix.shard * n / total) ** 2 / (mix.shard * n / total) for k in range(mix.drawn) for s, n in by_source.items())
    free = mix.drawn * (len(by_source) - 1)
    assert abs(spread - free) < 4 * math.sqrt(2 * free), (spread, free)
    took = mix.taken().groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1.5 * 64 + 3 for r in took if r["source_size"]), took


def test_reruns_agree_on_other_partitions(spark):
    rows = fixture()
    one = mixing.Mix(documents(spark, rows).repartition(7), block=16).taken().collect()
    two = mixing.Mix(documents(spark, rows[::-1]).repartition(2), block=16).taken().collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 97, 1000):
        side = int(n**0.5) + (int(n**0.5) ** 2 < n)
        got = spark.range(n).select(mixing._permuted(F.col("id"), F.lit(n), F.lit(side), F.lit(1), F.lit(2)).alias("x"))
        assert sorted(r["x"] for r in got.collect()) == list(range(n))


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [r for r in fixture() if r[0] is not None][:-2]
    docs = documents(spark, rows, ["note"])
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(docs, block=16).taken().collect()}
    texts, own = {r[0]: r[1] for r in rows}, defaultdict(int)
    for r in mixed.collect():
        w, base = W.findall(r["text"]), W.findall(texts[r["doc_id"]])
        own[r["doc_id"]] += len(w)
        at = [base.index(x) for x in w]
        assert at == sorted(at) and r["text"] == (texts[r["doc_id"]] if len(w) == len(base) else " ".join(w))
    assert own == {i: n for i, n in taken.items() if n}


def test_columns_of_any_name_are_kept(spark):
    rows = [r for r in fixture() if r[0] is not None][:40]
    names = ["_row", "row", "_taken", "_parts", "_size", "own", "taken", "parts", "_spans"]
    docs = documents(spark, rows, names)
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert all(r[c] == "x" for r in mixed.collect() for c in names)


def test_empty_tables(spark, odd_rows):
    assert mixing.Mix(documents(spark, [])).taken().collect() == []
    assert mixing.mixed_documents(documents(spark, [])).collect() == []
    assert mixing.Mix(documents(spark, [(1, None), (2, " ")])).taken().where("taken <> 0 or target <> 0").count() == 0
    assert mixing.Mix(documents(spark, odd_rows)).taken().count() == len(odd_rows)
