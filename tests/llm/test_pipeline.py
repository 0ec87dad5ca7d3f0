import random
import zlib

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from conftest_llm import DOCUMENT, documents  # noqa: E402

from tabularium.llm import fm, minhash  # noqa: E402
from tabularium.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean, toxic, copied and secret-bearing documents whose fate is known."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(240):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))]
        toxic = i % 6 == 0
        if toxic:
            w[10:10] = ["moron", "scum"]
        if i % 10 == 1:
            w[5:5] = ["password=abcdef123456789"]
        rows.append((i, " ".join(w), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "src0", 0) for i in range(1, 40) if i % 6]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    for name in list(out)[:-1]:
        assert out[name].columns == DOCUMENT.names
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in out.items()}
    assert ids["toxicity"] == {i for i in range(240) if i % 6} | {1000 + i for i in range(1, 40) if i % 6}
    assert ids["near_dedup"] == {i for i in range(240) if i % 6}
    texts = {r["doc_id"]: r["text"] for r in out["secret_scan"].collect()}
    assert all(("[SECRET]" in t) == (i % 10 == 1) and "abcdef123456789" not in t for i, t in texts.items())
    assert ids["mix_sources"] <= ids["secret_scan"] and ids["best_fit_pack"] == ids["mix_sources"]
    assert out["best_fit_pack"].groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == out["best_fit_pack"].count()


def test_every_query_is_registered():
    import __spark_entry__ as entry

    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)


def test_accepted_is_what_is_not_predicted(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = fm.train(docs, labels)
    scored = fm.score(docs, model)
    assert {r["doc_id"] for r in fm.accepted(docs, model).collect()} == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    assert scored.where("held_out").count() == sum(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs.collect())


def test_dedup_keeps_one_of_each_group(spark, folder):
    found = minhash.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    assert found.where("kept").count() == found.select("component_id").distinct().count() == 240


@pytest.mark.parametrize("some", [True, False])
def test_odd_rows_empty_tables_and_clashing_columns(spark, folder, odd_rows, some):
    names = ["_row", "_taken", "_parts", "_size", "_spans", "_words", "row", "item", "kept", "score"]
    rows = (list(odd_rows) + [(20, "near copy one two three four five six seven eight nine ten"), (21, "near copy one two three four five six seven eight nine ten")]) if some else []
    docs = documents(spark, rows, names)
    labels = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert labels
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        if name != "best_fit_pack":
            assert found.columns == docs.columns and found.schema == docs.schema
            assert all(r[c] == "x" for r in found.collect() for c in names)
        texts = sorted([(r["doc_id"], r["text"]) for r in found.collect()], key=str) if name != "best_fit_pack" else None
        if name == "near_dedup" and some:
            assert [t[0] for t in texts if t[0] == 4] == [4] and 21 not in [t[0] for t in texts] and len([t for t in texts if t[0] is None]) == 1
            assert {1, 2, 3, 6, 7, 8, 9} <= {t[0] for t in texts if t[0] is not None} | {9}
        if name == "mix_sources":
            assert all(t[1] and t[1].split() for t in texts)
        if name == "best_fit_pack":
            assert (found.count() > 0) == some
        docs = found
