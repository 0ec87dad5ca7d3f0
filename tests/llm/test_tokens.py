import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import CLASHES, documents
from tokenizers import Tokenizer

from tabularium.llm import packing, sharding, tokenfile
from tabularium.llm.tokens import token_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["don't stop it's 'tis", "a<|endoftext|>b <|startoftext|>!", "É́a é ́abc", "İstanbul ΣΑΣ ΑΣ.", "a\x1cb #\x1c$", "a\xa0b c", "naïve…«x»", "12a3 中文!", "ſs ﬁ Å. K", "x-y_z!!", "", "   \n"]


@pytest.fixture(scope="module")
def whole():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def rows_of(spark, data):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def test_ids_are_those_of_whole_texts(spark, data, whole):
    texts = ODD + [t for _, t in rows_of(spark, data)]
    for text, got in zip(texts, token_bytes(pa.array(texts), PATH), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole(text), text[:50]


def ids_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, data, whole, odd_rows):
    rows = rows_of(spark, data) + [(10_000 + (r[0] or 0) if r[0] else None, r[1]) for r in odd_rows]
    got = packing.packed_documents(documents(spark, rows, CLASHES), PATH, group=60).collect()
    by_row, by_sequence = {}, {}
    for r in got:
        by_row.setdefault((r["row"], r["doc_id"]), []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    pieces = []
    for i, text in rows:
        ids = [*whole(text), 0]
        pieces += [(i, k, a, len(ids[a : a + 2048]), ids_crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(str, pieces)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in got)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= 1.02 * total / 2048 + 2


def test_best_fit_takes_the_fullest_bin():
    bins, at, used = packing.best_fit(np.array([7, 6, 3, 4, 1]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 2] and at.tolist() == [0, 0, 7, 6, 0] and used.tolist() == [10, 10, 1]


def test_packing_of_items_that_never_fit_together_ends(spark):
    items = spark.range(500).selectExpr("id as item", "1100L + id % 7 as length")
    assert packing.pack(items, 2048, group=50).select("bin").distinct().count() == 500


def test_token_files(spark, data, whole, odd_rows):
    rows = rows_of(spark, data) + [(r[0] and r[0] + 10_000, r[1]) for r in odd_rows]
    manifest = tokenfile.write_tokens(documents(spark, rows, CLASHES), PATH, block=1000)
    got = sorted((tuple(r) for r in tokenfile.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want, at = sorted(((i, ids_crc([*whole(t), 2]), len(whole(t)) + 1) for i, t in rows), key=str), 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert sorted(((r[0], r[3], r[2]) for r in got), key=str) == want


def test_token_files_of_nothing(spark):
    assert tokenfile.read_tokens(tokenfile.write_tokens(documents(spark, []), PATH)).collect() == []
    assert packing.packed_documents(documents(spark, []), PATH).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits_there_and_back(bits, tmp_path):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    with pa.OSFile(str(tmp_path / "f"), "wb") as sink:
        writer = tokenfile.Writer(sink, bits, 64)
        for part in np.array_split(ids, 37):
            writer.add(1, part.astype("<u4").tobytes())
        writer.close()
    with pa.OSFile(str(tmp_path / "f")) as source:
        reader = tokenfile.Reader(source)
        assert np.array_equal(reader.ids(0, len(ids)), ids)
        for _ in range(50):
            a, b = sorted(random.Random(bits).sample(range(len(ids)), 2))
            assert np.array_equal(reader.ids(a, b), ids[a:b])
    assert (tmp_path / "f").stat().st_size < len(ids) * bits / 8 + len(ids) / 64 * 9 + 2000


def test_shards(spark, odd_rows):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(800)] + [(7, "y" * 90)] * 40 + [(8, "z" * 2500), (9, "z" * 900)] + [(r[0], r[1] and r[1][:900]) for r in odd_rows]
    got = sharding.shards(documents(spark, rows, CLASHES), limit=2000, cell_bits=2).collect()
    assert sorted(str((r["doc_id"], r["n_bytes"])) for r in got) == sorted(str((i, len((t or "").encode()))) for i, t in rows)
    sums, prefixes = {}, {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["n_bytes"]
        prefixes.setdefault((r["depth"], r["prefix"]), []).append(r)
    assert all(r["shard_bytes"] == sums[r["shard"]] for r in got)
    assert all(n <= 2000 or n >= 2500 and sum(r["shard"] == s for r in got) == 1 for s, n in sums.items())
    # no bucket could be joined with its sibling's half: the parent would not fit
    for (depth, prefix), own in prefixes.items():
        if depth:
            parent = sum(r["n_bytes"] for r in got if r["depth"] >= depth and r["prefix"] >> (r["depth"] - depth + 1) == prefix >> 1)
            assert parent > 2000
    assert sharding.shards(documents(spark, [])).collect() == []


def test_packed_sequences_hold_the_pieces(spark, whole):
    rows = [(i, " ".join(f"word{i} {j}" for j in range(40 * (i % 7)))) for i in range(60)] + [(None, None)]
    found = packing.sequences(documents(spark, rows, CLASHES), PATH, most=64, group=20).collect()
    assert all(len(r["ids"]) == 4 * r["n_ids"] <= 256 for r in found)
    joined = sorted(b for r in found for b in np.frombuffer(r["ids"], "<u4").tolist())
    assert joined == sorted(x for _, t in rows for x in [*whole(t), 0])


def test_small_bins_of_all_groups_meet(spark):
    items = spark.range(4000).selectExpr("id as item", "1 + (id * 7919) % 1000 as length")
    total = items.selectExpr("sum(length)").first()[0]
    placed = packing.pack(items, 2048, group=100)
    used = placed.join(items, "item").groupBy("bin").sum("length").collect()
    assert all(r[1] <= 2048 for r in used) and sum(r[1] <= 1024 for r in used) <= 1
    assert len(used) <= 1.01 * total / 2048 + 1


def test_other_tokenizers_are_asked_for_whole_texts(tmp_path, whole):
    import json

    from tabularium.llm.tokens import by_words, id_bits

    assert by_words(PATH) and id_bits(PATH) == 16
    parts = json.load(open(PATH))
    parts["normalizer"] = {"type": "NFC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(parts))
    tokenizer = Tokenizer.from_file(str(other))
    assert not by_words(str(other))
    for text, got in zip(ODD, token_bytes(pa.array(ODD), str(other)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_that_do_not_fit_are_an_error():
    with pytest.raises(ValueError):
        tokenfile.pack_bits(np.array([3, 1 << 16], np.uint32), 16)


def test_chains_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from tabularium.llm.sql import SHARDS

    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(400)) for i in range(200)] + [(7, "y" * rng.randrange(900)) for _ in range(60)] + [(None, "z" * rng.randrange(700)) for _ in range(30)] + [(500, "w" * 5000), (500, "w" * 5000), (501, None)]
    docs = documents(spark, rows, ["shard", "row"])
    docs.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = sorted(con.execute(SHARDS.replace("{limit}", "1000")).fetchall(), key=str)
    found = sharding.shards(spark.read.parquet(f"{tmp_path}/d"), 1000)
    got = sorted([tuple(r) for r in found.select("doc_id", "n_bytes", "depth", "prefix", "shard", "shard_bytes").collect()], key=str)
    assert got == want and {60, 7} < {r[2] for r in got}


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "y" * 400)] * 5
    docs = documents(spark, rows, ["shard", "row"])
    said = sharding.write_shards(docs, f"{tmp_path}/out", limit=1000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    sizes = back.groupBy("_shard").agg({"text": "count"}).collect()
    assert {r[0][1:] for r in sizes} == {r["shard"] for r in said.collect()} and max(r["shard_bytes"] for r in said.collect()) <= 1000

