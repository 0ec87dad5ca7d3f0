import random
from difflib import SequenceMatcher

from tabularium.operators import review


def test_reviews_equal_a_replay(spark):
    rng = random.Random(5)
    base = ["<div class=row><span>Ward 1</span><b>12</b></div>", "<ul><li>one<li>two</ul>", "<p>text of a page</p>"]
    entries = [(i, "".join(rng.choice([c, c, c, c, c, c, c, c, c, "x"]) if rng.random() < 0.3 else c for c in rng.choice(base)), f"old{i % 4}", f"p{rng.randrange(8)}") for i in range(60)]
    corrections = [(s, rng.randrange(70), rng.choice(["edit", "edit_similar", "edit_pattern", "remove", "edit"]), f"new{s}") for s in range(25)]
    labels, gone, patterns = {i: label for i, _, label, _ in entries}, set(), {f"p{k}": "kb" for k in range(9)}
    html, of = {e[0]: e[1] for e in entries}, {e[0]: e[3] for e in entries}
    for _, i, action, label in corrections:
        if i not in html:
            continue
        if action == "remove":
            gone.add(i)
            continue
        labels[i], patterns[of[i]] = label, label
        for j in html:
            if action == "edit_similar" and SequenceMatcher(None, html[j], html[i]).ratio() > 0.9 or action == "edit_pattern" and of[j] == of[i]:
                labels[j] = label
    table = spark.createDataFrame(entries, "id long, html string, label string, pattern_id string")
    changes = spark.createDataFrame(corrections, "seq long, id long, action string, label string")
    assert {(r["id"], r["label"]) for r in review.reviewed_segments(table, changes).collect()} == {(i, x) for i, x in labels.items() if i not in gone}
    kb = spark.createDataFrame([(p, "kb") for p in patterns], "pattern_id string, label string")
    assert {tuple(r) for r in review.reviewed_patterns(kb, table, changes).collect()} == set(patterns.items())


def test_anomalies(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, details string")
    changes = spark.createDataFrame([(1, 1, "edit", "x"), (2, 1, "edit", "y"), (3, 2, "resolve", None), (4, 9, "edit", "z")], "seq long, id long, action string, label string")
    assert {tuple(r) for r in review.resolved(rows, changes).collect()} == {(1, "y", False), (2, "b", True), (3, "c", False)}


def test_merges_equal_a_replay(spark):
    rng = random.Random(11)
    patterns = {i: {"label": rng.choice([None, f"l{i}"]), "features": {rng.choice("abcd"): f"{i}{k}" for k in range(rng.randrange(3))}} for i in range(80)}
    changes = [(s, i, rng.choice(["merge", "merge", "merge", "edit", "remove"]), f"new{s}", rng.choice([rng.randrange(10), rng.randrange(90), i, None])) for s, i in enumerate(rng.sample(range(85), 70))]
    # a long chain that holds, and one whose merges come from its end, so that they alternate
    patterns |= {i: {"label": f"c{i}", "features": {"x": str(i)}} for i in range(100, 140)}
    changes += [(1000 + i, i, "merge", None, i + 1) for i in range(100, 119)] + [(2000 - i, i, "merge", None, i + 1) for i in range(120, 139)]
    kb = {i: {"label": p["label"], "features": dict(p["features"])} for i, p in patterns.items()}
    for _, i, action, label, target in sorted(changes):
        if i not in kb:
            continue
        if action == "edit":
            kb[i]["label"] = label
        elif action == "remove" or action == "merge" and target == i:
            del kb[i]
        elif target in kb:
            own = kb.pop(i)
            kb[target]["features"].update(own["features"])
            kb[target]["label"] = kb[target]["label"] if own["label"] is None else own["label"]
    table = spark.createDataFrame([(i, p["label"], p["features"]) for i, p in patterns.items()], "pattern_id long, label string, features map<string,string>")
    told = spark.createDataFrame(changes, "seq long, pattern_id long, action string, label string, target long")
    got = {r["pattern_id"]: {"label": r["label"], "features": r["features"]} for r in review.merged_patterns(table, told).collect()}
    assert got == kb and got[119]["features"]["x"] == "100"
    same = review.merged_patterns(table, told.limit(0)).collect()
    assert {r["pattern_id"]: r["features"] for r in same} == {i: p["features"] for i, p in patterns.items()}
