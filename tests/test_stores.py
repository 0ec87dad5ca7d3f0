import random
import time

import pytest
from pyspark.sql import functions as F

from tabularium.operators import hints, plugins
from tabularium.runs import Run
from tabularium.session import new_path
from tabularium.sources import files
from tabularium.streaming import alerts


def table(spark, rows):
    return spark.createDataFrame(rows, "fragment string, module string")


def test_hints_equal_a_replay(spark, tmp_path):
    """After any sequence of steps the store holds what a list of snapshots does."""
    rng = random.Random(6)
    store, stack = hints.HintStore(spark, new_path(spark, "hints")), []
    assert store.current().collect() == [] and not store.undo() and not store.rollback(0)
    for step in range(14):
        now = dict(stack[-1]) if stack else {}
        rows = [(f" f{rng.randrange(5)} ", f"m{step}") for _ in range(2)]
        kind = rng.choice(["upsert", "upsert", "edit", "remove", "undo", "rollback", "import"])
        if kind == "upsert":
            store.upsert(table(spark, [*rows, ("", "x"), ("y", " ")]))
            stack.append(now | {f.strip(): m for f, m in rows})
        elif kind == "edit":
            store.edit(table(spark, rows))
            stack.append({f: dict((a.strip(), b) for a, b in rows).get(f, m) for f, m in now.items()})
        elif kind == "remove":
            store.remove(table(spark, rows).select(F.trim("fragment").alias("fragment")))
            stack.append({f: m for f, m in now.items() if f not in {a.strip() for a, _ in rows}})
        elif kind == "import":
            path = tmp_path / f"{step}.csv"
            path.write_text("URL Fragment,Module Path\n" + "".join(f"{a.strip()},{b}\n" for a, b in rows) + "lonely,\n")
            store.import_csv(str(path))
            stack.append(now | {f.strip(): m for f, m in rows})
        elif kind == "undo":
            assert store.undo() == (len(stack) > 1)
            stack = stack[:-1] if len(stack) > 1 else stack
        else:
            place = rng.randrange(len(stack) + 2)
            assert store.rollback(place) == (place < len(stack))
            stack = stack[: place + 1] if place < len(stack) else stack
        assert {tuple(r) for r in store.current().collect()} == set((stack[-1] if stack else {}).items()), (step, kind)
    assert [r["place"] for r in store.history().orderBy("place").collect()] == list(range(len(stack)))
    store.export_csv(f"file://{tmp_path}/out")
    again = hints.HintStore(spark, new_path(spark, "hints"))
    again.import_csv(f"file://{tmp_path}/out")
    assert {tuple(r) for r in again.current().collect()} == set(stack[-1].items())


def test_one_of_two_writers_fails(spark):
    store = hints.HintStore(spark, new_path(spark, "hints"))
    store.upsert(table(spark, [("a", "1")]))
    with pytest.raises(Exception, match="(?i)exist"):
        store._write("upsert", 1, 1, 1)
    assert store.log().count() == 1


def test_plugins_are_united_and_faults_stay_with_their_page(spark):
    @plugins.extractor("words")
    def words(html, *columns):
        for w in html.split():
            yield {"word": w, "size": len(w)}

    @plugins.extractor("strict")
    def strict(html, *columns):
        if "bad" in html:
            raise ValueError("bad page")
        yield {"word": html.upper()}

    pages = spark.createDataFrame([(1, "one two"), (2, "bad page"), (3, None)], "page_id long, html string")
    got = {tuple(r) for r in plugins.extracted(spark, pages, {"words": ["word", "size"], "strict": ["word"]}).collect()}
    want = {("words", 1, 0, "one", "3", None), ("words", 1, 1, "two", "3", None), ("words", 2, 0, "bad", "3", None), ("words", 2, 1, "page", "4", None)}
    want |= {("strict", 1, 0, "ONE TWO", None, None), ("strict", 2, None, None, None, "ValueError: bad page"), ("strict", 3, 0, "", None, None)}
    assert got == want
    with pytest.raises(KeyError):
        plugins.extracted(spark, pages, {"unknown": ["x"]})


def test_one_run_is_cancelled_and_the_other_ends(spark):
    slow = lambda: spark.range(0, 400_000_000_000, 1, 2).selectExpr("sum(hash(id))").collect()
    quick = lambda: spark.range(1000).selectExpr("sum(id)").first()[0]
    one, two = Run(spark, "slow", slow), Run(spark, "quick", quick)
    assert two.join(60) == "done" and two.result == 499_500
    until = time.time() + 60
    while not one.progress()["jobs"] and time.time() < until:
        time.sleep(0.1)
    assert one.state == "running" and one.progress()["tasks"] >= one.progress()["done"]
    one.cancel()
    assert one.join(60) == "cancelled" and two.state == "done"
    three = Run(spark, "wrong", lambda: spark.sql("select no_such_column").collect())
    assert three.join(60) == "failed" and three.error is not None


def contest_replay(text):
    """Line by line, with what is left of a contest's lines."""
    contests = []
    for line in [x.strip() for x in text.splitlines() if x.strip()]:
        if any(w in line.lower() for w in files.CONTEST_WORDS):
            contests.append((line, []))
        elif contests:
            contests[-1][1].append(line)
    rows = []
    for number, (contest, lines) in enumerate(contests, 1):
        for at in range(0, len(lines), 4):
            row = {"party": None, "percentage": None, "votes": None}
            for value in lines[at + 1 : at + 4]:
                if "%" in value:
                    row["percentage"] = value
                elif value.replace(",", "").isdigit():
                    row["votes"] = value
                elif any(w in value.lower() for w in files.PARTY_WORDS):
                    row["party"] = value
            rows.append((number, contest, at // 4, lines[at], row["party"], row["percentage"], row["votes"]))
    return rows


def test_contests_equal_a_replay(spark):
    rng = random.Random(2)
    lines = ["US Senate", "For President", "Ann Lee", "Jo Poe", "Democratic", "REPUBLICAN line", "write-in", "45.2%", "1,234", "99", "  ", "other words", "Republican 3%"]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(25))) for _ in range(60)] + ["", "Governor", "Governor\r\nAnn\r\n5%\x0b7", "no contest\nat all"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id long, text string")
    got = sorted(tuple(r) for r in files.contest_rows(rows, "id", "text").select("id", "contest_no", "contest", "row_no", "candidate", "party", "percentage", "votes").collect())
    assert got == sorted((i, *r) for i, t in enumerate(texts) for r in contest_replay(t))


def test_a_stream_that_starts_again_has_all_of_its_state(spark):
    folder, out = new_path(spark, "in"), new_path(spark, "out")
    schema = "user string, n long"
    put = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")

    def state():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        counts = stream.groupBy("user").agg(F.sum("n").alias("n"))
        return {tuple(r) for r in alerts.last_state(counts, ["user"], f"{out}/table", f"{out}/checkpoint").collect()}

    put([("a", 1), ("b", 2)], 0)
    assert state() == {("a", 1), ("b", 2)}
    put([("a", 10), ("c", 3)], 1)
    assert state() == {("a", 11), ("b", 2), ("c", 3)}
    assert state() == {("a", 11), ("b", 2), ("c", 3)}  # nothing new
