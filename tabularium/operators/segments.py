"""What a page segment is, by ordered rules, and rows cut out of segments by approved patterns.

Segments are those of ``sources.pages``: page_id, idx, tag, attrs, classes, parent_idx,
ancestors, text.  Rules read a segment's own tag, classes, id, attributes and its whole
text; markup is not kept with a segment, so a word counts if it stands in the text or in
a value of the segment's own attributes, not in a tag below it.  Nulls are blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabularium.functions import text as T
from tabularium.sources.pages import HEADINGS

# Fixed values of the rules, whatever the case.
IGNORED_TAGS = ("script", "style", "svg", "path", "defs", "g", "canvas", "noscript", "meta", "link", "base", "title")
IGNORED_CLASSES = ("visually-hidden", "sr-only", "skip-link", "screen-reader", "aria-hidden", "d-none", "hidden", "offscreen")
IGNORED_IDS = ("skip-link", "hidden", "aria-hidden")
DOWNLOADS = ("csv", "json", "pdf", "xlsx", "zip", "xls", "doc", "docx")
BUTTON_CLASSES = ("btn", "button", "toggle", "switch", "p-button", "mat-button", "v-btn", "ant-btn", "el-button")
HEADING_CLASSES = ("heading", "header", "title", "h1", "h2", "h3", "h4", "h5", "h6", "section-title", "panel-title")
PANEL_TAGS = ("section", "div", "fieldset", "article")
PANEL_CLASSES = ("panel", "card", "container", "box", "section-panel", "mat-card", "el-card", "ant-card", "v-card")
TIME_TAGS = ("span", "time", "div", "p", "small", "label")
TIME_CLASSES = ("time-ago", "timestamp", "last-updated", "results-timestamp", "update-time", "posted", "modified", "date", "datetime")
TIME_ATTRIBUTES = ("timeago", "datetime", "data-timestamp", "data-updated", "data-date", "data-time", "data-last-updated")
TIME_NAMES = r"timestamp|time[-_]?ago|last[-_]?updated|update[-_]?time|posted|modified|date|datetime"
TIME_TEXT = r"\b(ago|updated|last|posted|as of|reported)\b|\b\d{1,2}:\d{2}\s*(am|pm)?\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"
#: Families of icon fonts: a class that is one, or goes on with a hyphen behind one of these.
ICON_FAMILIES = ("bi", "eva", "fa", "fab", "fad", "fal", "far", "fas", "feather", "flaticon", "glyph", "glyphicon", "icn", "icofont", "icon", "iconfont", "iconify", "ion", "ionicon", "material-icons", "mdi", "octicon", "oi", "p-button-icon", "p-icon", "pi", "remixicon", "ri", "uicon", "uik")
_ICON = rf"^({'|'.join(ICON_FAMILIES)})(-.*)?$"
STRUCTURAL = ("br", "hr", "wbr", "col", "colgroup", "thead", "tbody", "tfoot", "tr", "th", "td")
CLICKABLE = ("a", "button")


def label(tag: Column, classes: Column, attrs: Column, text: Column) -> Column:
    """The first rule that holds: ignore, download_link, ballot_toggle, heading, panel, results_table, location_panel, candidate_panel, ballot_type, clickable, results_timestamp, ignore (blank), unknown."""
    attr = lambda name: F.lower(F.coalesce(F.element_at(attrs, F.lit(name)), F.lit("")))
    names = F.transform(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.lower(c))
    of = lambda known: F.arrays_overlap(names, F.array(*map(F.lit, known)))
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    own = F.concat_ws(" ", said, F.lower(F.array_join(F.coalesce(F.map_values(attrs), F.array().cast("array<string>")), " ")))
    keys = F.lower(F.array_join(F.coalesce(F.map_keys(attrs), F.array().cast("array<string>")), " "))
    id_, blank = attr("id"), said == ""
    icons = F.size(names) > 0
    icon = F.exists(names, lambda c: F.regexp_like(c, F.lit(_ICON)))
    # a span is an icon if all its classes say so and it holds nothing
    only_icons = icons & F.forall(names, lambda c: F.regexp_like(c, F.lit(_ICON))) & blank
    ignored = tag.isin(*IGNORED_TAGS) | of(IGNORED_CLASSES) | id_.isin(*IGNORED_IDS) | (tag.isin("i", "svg", "path", "g") & icon) | ((tag == "span") & only_icons) | (tag.isin("i", "span") & blank)
    download = (tag == "a") & F.regexp_like(attr("href"), F.lit(rf"\.({'|'.join(DOWNLOADS)})$"))
    button = (tag == "button") | ((tag == "input") & attr("type").isin("button", "submit"))
    clickable = tag.isin(*CLICKABLE) | F.coalesce(F.map_contains_key(attrs, F.lit("onclick")), F.lit(False))
    timed = tag.isin(*TIME_TAGS) & (of(TIME_CLASSES) | F.regexp_like(id_, F.lit(TIME_NAMES)) | F.regexp_like(keys, F.lit(TIME_NAMES + "|timeago|data-time")) | F.regexp_like(said, F.lit(TIME_TEXT)))
    rule = F.when(ignored, "ignore").when(download, "download_link").when(button | of(BUTTON_CLASSES) | F.contains(id_, F.lit("toggle")), "ballot_toggle")
    rule = rule.when(tag.isin(*HEADINGS) | of(HEADING_CLASSES), "heading").when(tag.isin(*PANEL_TAGS) | of(PANEL_CLASSES), "panel").when(tag == "table", "results_table")
    rule = rule.when(T.any_word(own, T.LOCATION_WORDS), "location_panel").when(T.any_word(own, T.CANDIDATE_WORDS), "candidate_panel").when(T.any_word(own, T.BALLOT_ORDER), "ballot_type")
    return rule.when(clickable, "clickable").when(timed, "results_timestamp").when(blank, "ignore").otherwise("unknown")


def labelled(found: DataFrame) -> DataFrame:
    """Segments with their label."""
    return found.withColumn("label", label(F.col("tag"), F.col("classes"), F.col("attrs"), F.col("text")))


_SELECTOR = r"^([A-Za-z][A-Za-z0-9]*)?(?:#([-\w]+))?((?:\.[-\w]+)*)$"


def _parts(selector: Column) -> Column:
    """tag, id and classes of a simple selector: 'div#x.a.b', '.a', 'li', '*'."""
    plain = F.regexp_replace(F.coalesce(selector, F.lit("")), r"^\*", "")
    part = lambda i: F.regexp_extract(plain, _SELECTOR, i)
    return F.struct(F.lower(part(1)).alias("tag"), part(2).alias("id"), F.filter(F.split(part(3), r"\."), lambda c: c != "").alias("classes"))


def _fits(parts: str) -> Column:
    """Whether a segment (tag, attrs, classes) is what a selector's parts ask for."""
    asked = lambda c: F.col(f"{parts}.{c}")
    id_ = F.coalesce(F.element_at("attrs", F.lit("id")), F.lit(""))
    return ((asked("tag") == "") | (asked("tag") == F.col("tag"))) & ((asked("id") == "") | (asked("id") == id_)) & (F.size(F.array_except(asked("classes"), "classes")) == 0)


def pattern_rows(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, page_id, table_idx, heading, row_idx, row_no, cells: rows that the approved patterns cut out.

    ``patterns``: pattern_id, approved, selector, and, null where all will do, cell_selector
    ('> li', '> *': children; 'li': any segment below; null: '> *'), row_tag, row_class (a
    part of the class text), row_text (a part of the text), heading (null: 'Pattern:
    selector #i', i from 0 in the page).  Selectors are of one step, a tag, an id, classes;
    what is none matches nothing.  row_no counts the rows kept, in page order, within a
    container; cells are the texts of a row's children.

    Containers are met by an equality on the most telling part of their selector (a class,
    else the id, else the tag); a pattern for every segment meets all of them once.
    """
    approved = patterns.where(F.coalesce("approved", F.lit(False))).withColumn("_box", _parts(F.trim("selector")))
    step = F.trim(F.coalesce("cell_selector", F.lit("> *")))
    approved = approved.withColumn("_direct", F.startswith(step, F.lit(">"))).withColumn("_row", _parts(F.trim(F.regexp_replace(step, "^>", ""))))
    sound = lambda c: F.regexp_like(F.regexp_replace(F.trim(c), r"^\*", ""), F.lit(_SELECTOR))
    approved = approved.where(sound(F.col("selector")) & (F.trim("selector") != "") & sound(F.regexp_replace(step, r"^>\s*", "")))
    key = F.when(F.size("_box.classes") > 0, F.concat(F.lit("."), F.element_at("_box.classes", 1))).when(F.col("_box.id") != "", F.concat(F.lit("#"), F.col("_box.id"))).when(F.col("_box.tag") != "", F.col("_box.tag")).otherwise("*")
    asked = approved.select("pattern_id", "selector", "heading", "row_tag", "row_class", "row_text", "_box", "_row", "_direct", key.alias("_key"))
    told = F.array_distinct(F.array_compact(F.concat(F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.array(F.concat(F.lit("#"), F.element_at("attrs", F.lit("id"))), F.col("tag"), F.lit("*")))))
    boxes = found.select("page_id", F.col("idx").alias("table_idx"), "tag", "attrs", "classes", F.explode(told).alias("_key")).join(asked, "_key").where(_fits("_box"))
    nth = F.row_number().over(Window.partitionBy("pattern_id", "page_id").orderBy("table_idx")) - 1
    boxes = boxes.withColumn("heading", F.coalesce("heading", F.concat(F.lit("Pattern: "), "selector", F.lit(" #"), nth.cast("string")))).drop("tag", "attrs", "classes", "_key", "selector", "_box")
    below = found.select("page_id", F.col("idx").alias("row_idx"), "parent_idx", "tag", "attrs", "classes", "text", F.explode("ancestors").alias("table_idx"))
    met = boxes.join(below, ["page_id", "table_idx"]).where((~F.col("_direct") | (F.col("parent_idx") == F.col("table_idx"))) & _fits("_row"))
    holds = lambda text, part: F.coalesce(F.contains(text, F.col(part)), F.lit(True))
    met = met.where(F.coalesce(F.col("tag") == F.lower("row_tag"), F.lit(True)) & holds(F.coalesce(F.element_at("attrs", F.lit("class")), F.lit("")), "row_class") & holds(F.col("text"), "row_text"))
    rows = met.select("pattern_id", "page_id", "table_idx", "heading", "row_idx").withColumn("row_no", F.row_number().over(Window.partitionBy("pattern_id", "page_id", "table_idx").orderBy("row_idx")) - 1)
    cells = found.where("parent_idx is not null").groupBy("page_id", F.col("parent_idx").alias("row_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: F.trim(c["text"])).alias("cells"))
    return rows.join(cells, ["page_id", "row_idx"], "left").select("pattern_id", "page_id", "table_idx", "heading", "row_idx", "row_no", F.coalesce("cells", F.array().cast("array<string>")).alias("cells"))
