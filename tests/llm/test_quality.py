import re
from collections import Counter, defaultdict

from conftest_llm import CLASHES, documents

from tabularium.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, most_docs=20):
    held = defaultdict(set)
    lines = []
    for n, r in enumerate(rows):
        n = ("row", n) if r[0] is None else r[0]  # rows of one id are one document
        own = [x for x in (r[1] or "").split("\n") if W.search(x)]
        host = r[2] if len(r) > 2 else "s"
        keyed = [(host, tuple(W.findall(x.lower()))) for x in own]
        for k in keyed:
            held[k].add(n)
        lines.append((own, keyed))
    out = []
    for r, (own, keyed) in zip(rows, lines, strict=True):
        text = r[1] or ""
        w = W.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        left = len(w) - sum(len(k[1]) for k in keyed if len(held[k]) > most_docs)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(cover), failed, not failed and 2 * left >= len(w), left))
    return sorted(out, key=str)


def run(df):
    return sorted([tuple(r) for r in quality.judged(df).collect()], key=str)


def test_same_as_brute_force(spark, odd_rows):
    rows = list(odd_rows)
    line = "this page may not be copied without leave of its owner"
    for i in range(60):
        own = [" ".join(f"w{(i * 31 + j * 7) % (40 + i)}" for j in range(20)) for _ in range(i % 4 + 1)]
        rows.append((100 + i, "\n".join([*own, line.upper() if i % 2 else line, "  ", line] if i < 45 else own), f"host{i % 2}"))
        rows.append((200 + i, "\n".join(f"{line} {j % 3}" for j in range(i % 9)) + "\r\n# * $|", "host0"))
    assert run(documents(spark, rows, CLASHES)) == brute(rows)


def test_empty_table(spark):
    assert run(documents(spark, [])) == []


def test_rows_of_one_id_are_one_document(spark):
    line = "all rights are reserved by the owners of this host and its partners"
    own = lambda i: "\n".join([line, *(" ".join(f"w{i}_{j}_{k}" for k in range(9)) for j in range(8))])
    rows = [(1, own(1))] * 30 + [(2, own(2))] * 30 + [(100 + i, own(100 + i)) for i in range(18)]
    assert run(documents(spark, rows)) == brute(rows) and all(r[7] and r[8] == r[1] for r in brute(rows))
    more = rows + [(200, own(200))]
    assert run(documents(spark, more)) == brute(more) and all(r[8] < r[1] for r in brute(more))


def test_long_repeats_and_windows_beside_each_other(spark):
    texts = ["a b c a b c", "x " * 5000, "a b c d e a b c d f a b c", "p q r " + "s t u " * 300 + "p q r", " ".join(f"w{i}" for i in range(3000)) + " w0 w1 w2"]
    rows = list(enumerate(texts))
    assert run(documents(spark, rows)) == brute(rows)


def test_texts_without_common_lines(spark):
    line = "Read more on our page today"
    rows = [(i, f"{line}\nown {i} words of this text\n\n{line.upper()}" if i < 30 else f"{line}\n", f"h{i % 2}") for i in range(60)] + [(100, None), (101, "kept\nas it is")]
    docs = documents(spark, rows, ["gone", "row", "lines"])
    got = {r["doc_id"]: r["text"] for r in quality.without_common_lines(docs, 20, 0.3).collect()}
    assert quality.without_common_lines(docs).columns == docs.columns
    assert got == {**{i: f"own {i} words of this text\n" for i in range(30)}, 100: None, 101: "kept\nas it is"}

