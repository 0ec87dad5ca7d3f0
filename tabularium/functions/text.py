"""Scalar text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabularium.functions.fuzzy import ratio

# Keyword lists of the domain.  "ed" (election district) is no word here: as a part it stands in every "reported" and "received";
# words are looked for in lower case, so forms in other cases are left out.
BALLOT_ORDER = ("election day", "early voting", "absentee", "mail", "absentee mail")
LOCATION_WORDS = ("precinct", "ward", "district", "location", "area", "city", "municipal", "town", "borough", "village", "county", "division", "subdistrict", "polling place", "municipality")
TOTAL_WORDS = ("total", "sum", "votes", "overall", "all")
MISC_WORDS = ("undervote", "overvote", "scattering", "write-in", "blank", "void", "spoiled")
CANDIDATE_WORDS = ("candidate", "candidates", "name", "nominee", "person", "individual", "contestant")
NOISE_WORDS = ("test", "sample", "unknown", "n/a", "tbd", "lorem", "ipsum")


def collapse(text: Column) -> Column:
    """Lower case, single spaces, no space around."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def label(text: Column) -> Column:
    """Lower case without anything but word characters of any script."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


def column_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]", "")


def contest_title(text: Column) -> Column:
    """Without the note on how many to vote for."""
    return F.trim(F.regexp_replace(text, r"(?i)\(?\s*vote for \d+\s*\)?", ""))


def place(text: Column) -> Column:
    """Without the word county."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\bcounty\b", ""), r"\s+", " "))


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9 _-]", "_")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def year(text: Column) -> Column:
    """The first year from 1900 to 2099, or null."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def votes(text: Column) -> Column:
    """A count written with or without thousands commas; null if it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")


def percent_reported(text: Column) -> Column:
    """'n%' of 'n % reported'; 100% of 'fully reported'; else null."""
    found = F.regexp_extract(F.lower(text), r"(\d{1,3})\s*%[\s\-]*reported", 1)
    return F.when(found != "", F.concat(found, F.lit("%"))).when(F.contains(F.lower(text), F.lit("fully reported")), F.lit("100%"))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def words_present(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains."""
    low = F.lower(text)
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def keyphrase(text: Column, phrase: str, least: float = 0.8) -> Column:
    """The phrase at the end (blanks and colons behind it aside), a text like the phrase, or two of its words."""
    low, said = F.lower(F.trim(text)), phrase.lower().strip()
    parts = tuple(dict.fromkeys(re.findall(r"\w+", said)))
    ends = F.regexp_like(low, F.lit(r"\s+".join(map(re.escape, said.split())) + r"[\s:]*$"))
    # a text much shorter or longer is not like the phrase, and is not compared
    near = F.length(low).between(len(said) * least / (2 - least) - 1e-6, len(said) * (2 - least) / least + 1e-6)
    alike = F.coalesce(ratio(F.when(near, low), F.lit(said)) >= least, F.lit(False))
    return ends | alike | ((words_present(low, parts) >= 2) if len(parts) > 1 else F.lit(False))


def emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), 1)


def strip_html(html: Column) -> Column:
    """Text of a page: scripts and styles dropped, breaks as lines, tags as spaces."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"[ \t\n\r]+", " "))


def signature(headers: Column) -> Column:
    """md5 of the header list, in order."""
    return F.md5(F.array_join(headers, "\x1f"))


def context_windows(text: Column, word: str, around: int = 30) -> Column:
    """For each hit of the word, whatever the case and overlapping ones too, the text from ``around`` characters before it to as many behind it."""
    literal = re.sub(r"([^\w\s])", r"\\\1", word)
    pattern = F.lit(rf"(?is)(?=({literal}.{{0,{around}}}))(?<=(^.{{0,{around - 1}}}|.{{{around}}}))")
    return F.zip_with(F.regexp_extract_all(text, pattern, 2), F.regexp_extract_all(text, pattern, 1), lambda before, own: F.concat(before, own))


def without_overlaps(spans: Column) -> Column:
    """Spans (start, end, label) by start, longest first, each dropped that starts before the last kept one ends."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(b.end - a.end))
    step = lambda kept, s: F.when(F.coalesce(F.get(kept, F.size(kept) - 1).end, F.lit(-1)) <= s.start, F.array_append(kept, s)).otherwise(kept)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def delimiter(text: Column) -> Column:
    """Of comma, tab, semicolon and bar, the one most frequent in the first ten lines; the first named wins a tie."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n")
    marks = (",", "\t", ";", "|")
    counts = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(m), F.lit("")))).alias("n"), F.lit(-i).alias("rank"), F.lit(m).alias("mark")) for i, m in enumerate(marks)]
    return F.greatest(*counts).mark
