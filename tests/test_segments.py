import random
import re

from tabularium.operators import segments as S
from tabularium.sources import pages as P


def _label(spark, rows):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tag string, classes array<string>, attrs map<string,string>, text string")
    return [r["label"] for r in S.labelled(table).orderBy("i").collect()]


def test_labels_by_rule_and_order(spark):
    rows = [
        ("p", ["Hidden"], {}, "Ward 1"), ("svg", [], {}, "x"), ("p", [], {"id": "Skip-Link"}, "x"), ("span", ["fa", "fa-check"], {}, ""), ("span", ["fa", "big"], {}, "Total"), ("i", ["icon-bg-dark"], {}, "x"),
        ("a", [], {"href": "/f.XLSX"}, "Ward 1"), ("a", [], {"href": "/f.csv?x"}, "f"), ("a", ["btn"], {"href": "/f"}, "Ward 1"), ("input", [], {"type": "Submit"}, ""), ("p", [], {"id": "my-toggle"}, "x"),
        ("p", ["panel-title"], {}, "x"), ("li", ["Card"], {}, "x"), ("table", [], {}, "Ward 1"), ("td", [], {"title": "County"}, "7"), ("td", [], {}, "Nominee"), ("td", [], {}, "Absentee"),
        ("li", [], {"onclick": "go"}, "12:30"), ("p", [], {}, "12:30"), ("li", [], {}, "12:30"), ("p", [], {"data-updated": "x"}, "-"), ("td", [], {}, "  "), ("td", [], {}, "7"), ("p", None, None, None), (None, None, None, None)]
    want = ["ignore", "ignore", "ignore", "ignore", "unknown", "ignore", "download_link", "clickable", "ballot_toggle", "ballot_toggle", "ballot_toggle", "heading", "panel", "results_table", "location_panel", "candidate_panel", "ballot_type",
            "clickable", "results_timestamp", "unknown", "results_timestamp", "ignore", "unknown", "ignore", "ignore"]
    assert _label(spark, rows) == want


def _replayed(found, patterns):
    """Patterns over segments one by one: found is page -> segments in order."""

    def fits(seg, selector):
        tag, rest = re.match(r"(\*|\w*)(.*)", selector).groups()
        ids, classes = re.findall(r"#([-\w]+)", rest), re.findall(r"\.([-\w]+)", rest)
        return tag in ("", "*", seg["tag"]) and all(seg["attrs"].get("id") == i for i in ids) and set(classes) <= set(seg["classes"])

    out = []
    for pid, ok, selector, step, tag, cls, text, heading in patterns:
        for page, segs in found.items():
            for n, box in enumerate([s for s in segs if ok and fits(s, selector)]):
                step_ = step or "> *"
                inner = [s for s in segs if (s["parent_idx"] == box["idx"] if step_.startswith(">") else box["idx"] in s["ancestors"]) and fits(s, step_.strip("> "))]
                inner = [s for s in inner if (tag is None or s["tag"] == tag) and (cls is None or cls in s["attrs"].get("class", "")) and (text is None or text in s["text"])]
                out += [(pid, page, box["idx"], heading or f"Pattern: {selector} #{n}", s["idx"], k, tuple(c["text"] for c in segs if c["parent_idx"] == s["idx"])) for k, s in enumerate(inner)]
    return sorted(out)


def test_patterns_equal_a_replay(spark):
    rng = random.Random(8)

    def made(depth):
        tag = rng.choice(["div", "p", "ul", "li", "span"] if depth else ["p", "span"])
        classes = " ".join(rng.sample(["row", "cell", "x-row", "b"], rng.randrange(3)))
        own = (f' class="{classes}"' if classes else "") + (f' id="n{rng.randrange(3)}"' if rng.random() < 0.3 else "")
        inner = "".join(made(depth - 1) for _ in range(rng.randrange(4))) if depth and tag not in ("p", "span") else rng.choice(["Total 5", "Ann", "", "7"])
        return f"<{tag}{own}>{inner}</{tag}>"

    pages = spark.createDataFrame([(i, "".join(made(4) for _ in range(3))) for i in range(40)] + [(50, ""), (51, None)], "page_id long, html string")
    patterns = [
        (1, True, "div.row", None, None, None, None, None), (2, True, ".row", "> *", "li", None, None, "Rows"), (3, True, "div", "span", None, "row", None, None), (4, True, "*", "li.cell", None, None, "a", None),
        (5, True, "#n1", "*", None, None, "Total", None), (6, False, "div", None, None, None, None, None), (7, True, "ul#n2.b", "> .cell", None, "x-", None, None), (8, True, "div.row.b", "p", None, None, None, None)]
    schema = "pattern_id int, approved boolean, selector string, cell_selector string, row_tag string, row_class string, row_text string, heading string"
    odd = [(20, None, "div", None, None, None, None, None), (21, True, None, None, None, None, None, None), (22, True, "div > p", None, None, None, None, None), (23, True, "", None, None, None, None, None)]
    found = P.segments(pages).cache()
    plain = {}
    for r in found.orderBy("page_id", "idx").collect():
        plain.setdefault(r["page_id"], []).append(r.asDict())
    got = sorted((r["pattern_id"], r["page_id"], r["table_idx"], r["heading"], r["row_idx"], r["row_no"], tuple(r["cells"])) for r in S.pattern_rows(found, spark.createDataFrame(patterns + odd, schema)).collect())
    want = _replayed(plain, patterns)
    assert got == want and {r[0] for r in want} >= {1, 2, 3, 4, 5}
    found.unpersist()
