import json
import random

from tabularium.operators import nested


def merged(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merged(a[k], b[k]) if k in a and k in b else b[k] if k in b else a[k] for k in {*a, *b}}
    return b


def value(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind > 3:
        return {rng.choice(["a", "b", "é", "a/1:b", "x y"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [rng.randrange(9), None, [value(rng, 0), {"a": 1}] if depth else [1], rng.choice(["text", "", True, 1.5])][kind]


def test_same_as_a_recursive_merge(spark):
    rng = random.Random(3)
    pairs = [({"k": value(rng, 4), "m": value(rng, 3)}, {"k": value(rng, 4), "n": value(rng, 2), "m": {"a": value(rng, 2)}}) for _ in range(60)]
    pairs += [({}, {}), ({"a": {}}, {"a": {}}), ({"a": 1}, {"a": None}), ({"a": {"b": 1}}, {"a": [1]}), ({"a": [1, 2]}, {"a": {"b": {}}}), ([1], {"a": 1}), ({"a": 1}, "text")]
    rows = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(900, None, '{"a":1}'), (901, '{"a":1}', None), (902, None, None)], "id long, a string, b string")
    got = {r["id"]: json.loads(r["merged"]) for r in nested.deep_merged(rows, "id", "a", "b").collect()}
    assert got == {i: merged(a, b) for i, (a, b) in enumerate(pairs)} | {900: {"a": 1}, 901: {"a": 1}, 902: {}}
    assert nested.deep_merged(rows.where("false"), "id", "a", "b").collect() == []
