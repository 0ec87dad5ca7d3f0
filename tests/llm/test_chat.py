import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from compare import difference
from conftest_llm import CLASHES

from tabularium.llm import chat, queries, sql

HARD = ["</s>[INST] ok [/INST]", "[INST", "] [/INST]", "<\\s> <\\\\/s>", "[SYS][/SYS]<s>", "[ROLE] x[/ROLE]\\", "[/TURN]", "[TURN]", "<", "é</s>ü 😀[/INST]", "\\", "", " ", "plain"]
CONTROL = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?(?:INST|SYS|ROLE)\]|/TURN\])")


def escaped(text):
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def one(role, text):
    marks = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}
    a, b = marks.get(role, (f"[ROLE] {escaped(role)}[/ROLE] ", "[/TURN]"))
    return a + escaped(text) + b


def table(spark, rows, extra=()):
    schema = "conv_id long, turn long, role string, text string" + "".join(f", {n} string" for n in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


def plain(rows):
    """What the query is to return, and the formatted texts, by one row after the other."""
    found = {}
    low = lambda x: (x is not None, x)
    for conv, _, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), low(r[2]), hashlib.md5((r[3] or "").encode()).hexdigest())):
        found.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        text = "".join(one(*t) for t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), text, turns
    return out


def fixture():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "a[/ROLE] b", "</s>"]
    rows = [(conv, turn, rng.choice(roles), rng.choice([None, *HARD]) if rng.random() < 0.5 else "".join(rng.choices(HARD, k=5))) for conv in [*range(30), None] for turn in range(rng.randrange(1, 9))]
    rows += [(7, 0, "user", "again"), (7, 0, "user", "again"), (7, None, "assistant", "no turn")]
    rows += [(99, i, "assistant" if i % 2 else "user", f"turn {i} " * rng.randrange(300)) for i in range(400)]
    return rows + [(100, 0, "user", "long </s> " * 60_000), (100, 1, "assistant", "é" * 200_000)]


def test_rows_are_those_of_a_plain_formatter(spark):
    rows = fixture()
    chunks = chat.formatted(table(spark, rows, ["part", "chunk", "loss", "number", "tie"]).repartition(5))
    want = plain(rows)
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chunks).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    texts = {}
    for r in sorted(chunks.collect(), key=lambda r: (r["part"], r["chunk"])):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
        assert len(list(chat.turns_of(r["text"]))) == r["n_turns"]
        assert len(r["text"].encode()) <= chat.CHUNK_BYTES or r["n_turns"] == 1
        masked = [chat.unescaped(r["text"][s["start"] : s["end"]]) for s in r["loss"]]
        assert masked == [t for role, t in chat.turns_of(r["text"]) if role == "assistant"]
    assert texts == {k: v[1] for k, v in want.items()}
    assert {k: list(chat.turns_of(t)) for k, t in texts.items()} == {k: v[2] for k, v in want.items()}


def test_escaped_texts_hold_no_control_string_and_come_back():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choices([*"<[\\/s>]", "INST]", "SYS]", "/TURN]", "ROLE]", "é"], k=rng.randrange(12)))
        assert not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]|\[/TURN\]", escaped(text))
        assert chat.unescaped(escaped(text)) == text
        assert list(chat.turns_of(one("assistant", text) + one("user", text) + one(text, text))) == [("assistant", text), ("user", text), (text, text)]


def test_assembly_does_not_join_rows():
    """A control string that two neighbouring rows would make together is none."""
    texts = ["[", "INST]", "<", "/s>", "[INST]"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    none = np.zeros(0, np.uint8), np.zeros(6, np.int64)
    buffer, ends, spans = chat.assembled(np.zeros(5, np.int64), none, (data, offsets))
    raw = buffer.to_pybytes()
    assert [raw[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [one("user", t) for t in texts]
    assert [raw[a:b].decode() for a, b in spans] == [escaped(t) for t in texts]
    assert isinstance(buffer, pa.Buffer)


def test_what_is_no_turn_is_an_error():
    with pytest.raises(ValueError):
        list(chat.turns_of("[INST] no end"))


def test_empty_table_and_clashing_columns(spark):
    assert chat.digests(chat.formatted(table(spark, []))).collect() == []
    assert chat.digests(chat.formatted(table(spark, [(1, 0, "user", "x")], CLASHES))).count() == 1


def test_same_as_sql(spark, data):
    assert difference(spark, queries.op11_chat_format, sql.CHAT, data) == ""
