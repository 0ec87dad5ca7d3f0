"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

Fixed kinds, leftmost and without overlap within a kind: ``assign`` (a keyword,
a separator and 12 or more value characters), ``access`` (AKIA and 14 or more),
``hex`` (16 or more).  The method adds kind ``guess``: in a wider set of
credential contexts (other keywords, shorter values, other characters, "is",
user:password@ in addresses), the value, up to its closing quote or white space, is cut into segments at minimum total
guess cost by dynamic programming over

- words: log10 of the rank in the corpus's own frequency list, one more for
  capitals or letter-like digits;
- dates: 8 or 6 digits or separated fields that are a date: log10(36,500);
- repeats: the cost of the repeated unit plus log10 of the count;
- keyboard walks: neighbours on one row of a keyboard, alphabet or digits;
- brute force: log10 of the character class's size for each character;

each further segment costs log10(2).  A value without quotes goes on behind each of
``"',;<>`` if what follows, up to the next one, is neither a field (name=) nor a tag and
costs four orders or more by itself, so no tail of a secret stays, and no other text goes.  A value that fixed spans cover is theirs;
one that reaches beyond them is costed whole and may overlap them.  A value of ``least`` orders of magnitude
or more is a secret.  The programme runs over the whole value and ends early only
where every way to go on has reached that limit already.

The words are counted and ranked over all texts, without those that stand as a
value themselves: a password is no word for having been written.  Rows with context values are
few: the words that parts of their values may be are joined by shuffle with the
whole ranked list, so each row gets the ranks that its own values need and no
word is left out, however many there are.

Defined results: null or empty texts have no spans; offsets are code points,
ends exclusive; a very long text is scanned whole, by itself; rows are scanned one
by one, so repeated rows and null ids do not matter; equal counts of words are
ranked by the word; an empty table has no rows; other columns are kept as they
are, whatever their names, but for one named like the column of spans, which
these replace.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, dealt, free_name, running, ship_package
from .textcore import release, slices, tidy

KINDS = ("assign", "access", "hex", "guess")

# The patterns of the fixed kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|(?:private|access|auth|client)[_-]?(?:key|token|secret)|credentials?|bearer)"""
    r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)(?:(?P<quote>["'])(?P<quoted>[^\s]+?)(?=(?P=quote)|\s|$)|(?P<bare>[^\s"'][^\s]*))|://[^\s/:@]+:(?P<login>[^\s/@]{6,})@""",
    re.ASCII | re.IGNORECASE,
)
#: A value may go on behind these, or end there.
_MARKS = re.compile(r"""["',;<>]""")
#: What begins a field or a tag of its own: no value goes on with it.
_OTHER = re.compile(r"""["',;]["'{\[]?[A-Za-z_][\w.-]*["']?\s*[:=]|</?[A-Za-z][^<>]*(?:>|$)|>""")
_ENDS, _LEAST_TAIL = ".!?)]}:\"',;<>", 4.0
# by lookahead: a match that reaches into the next row must not hide one that starts there
_HINTS = re.compile(rb"(?=pass|pwd|secret|token|key|credential|bearer|AKIA|://)", re.IGNORECASE)

ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {x[::-1] for x in _NEXT}
LEET = str.maketrans("013457@$", "oieastas")
DATE = re.compile(r"(?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)?\d\d|(?:19|20)\d\d([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:\d\d)?\d\d|(?:19|20)\d\d")
_MOST_WORD = 24
_TRIMMED = ".,;:!?()[]\"'*&#$%|"


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _least(starts: list[tuple[int, float]], end: int, unit: int, times: int, limit: float) -> float:
    """Least of cost + log10(units) over the (start, cost) that are ``times`` whole units or more before ``end``.

    Drops those that reach ``limit`` or that another one beats at every later end too:
    an earlier one that is no worse here, or a later one of no higher cost.
    """
    best, keep, at = math.inf, [], []
    for s, cost in starts:
        if (end - s) % unit or end - s < times * unit:
            keep.append((s, cost))
        elif (value := cost + math.log10((end - s) // unit)) < min(best, limit):
            best = value
            while at and at[-1][1] >= cost:
                at.pop()
            at.append((s, cost))
    starts[:] = sorted(at + keep)
    return best


def guess_cost(value: str, ranks: dict[str, int], limit: float = math.inf) -> float:
    """Least log10 of guesses over all segmentations; infinite where that is ``limit`` or more."""
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))
    best = [0.0] + [math.inf] * n
    joint, walk = math.log10(2), math.log10(4 * 47)
    guessed = math.inf  # least cost before a segment by brute force, less the brute force up to there
    walks: list[tuple[int, float]] = []
    repeats: list[list[tuple[int, float]]] = [[] for _ in range(9)]
    furthest = 0  # the last end below the limit that a word or a date has reached
    for i in range(n + 1):
        if i:
            best[i] = min(best[i], guessed + brute[i])
            if i > 1 and low[i - 2] + low[i - 1] not in _NEXT:
                walks = [x for x in walks if x[0] >= i - 1]
            best[i] = min(best[i], walk + _least(walks, i, 1, 3, limit - walk))
            for unit in range(1, 9):
                if repeats[unit]:
                    if i > unit and low[i - 1] != low[i - 1 - unit]:
                        repeats[unit] = [x for x in repeats[unit] if x[0] >= i - unit]
                    best[i] = min(best[i], _least(repeats[unit], i, unit, 2, limit))
        if best[i] >= limit:
            if guessed + brute[i] >= limit and furthest <= i and not walks and not any(repeats):
                return math.inf
            continue
        here = best[i] + (joint if i else 0.0)
        guessed = min(guessed, here - brute[i])
        walks.append((i, here))
        for unit in range(1, min(8, (n - i) // 2) + 1):
            repeats[unit].append((i, here + brute[i + unit] - brute[i]))

        def offer(end: int, cost: float, here: float = here) -> None:
            nonlocal furthest
            if here + cost < best[end]:
                best[end] = here + cost
                if best[end] < limit:
                    furthest = max(furthest, end)

        for j in range(i + 3, min(n, i + _MOST_WORD) + 1):
            rank = ranks.get(low[i:j])
            if rank is not None:
                offer(j, math.log10(rank + 1) + (value[i:j] != low[i:j]))
            elif (rank := ranks.get(plain[i:j])) is not None:
                offer(j, math.log10(rank + 1) + 1)
        if found := DATE.match(value, i):
            offer(found.end(), math.log10(36_500))
    return best[n] if best[n] < limit else math.inf


def _values(text: str, fixed: list[tuple[int, int]]) -> Iterator[tuple[int, list[int]]]:
    """Start and possible ends of the values of credential contexts that reach beyond the fixed spans.

    A value is what stands up to its closing quote or white space; it may end before each
    mark inside, or at its own end.
    """
    for m in CONTEXT.finditer(text):
        kind = next(k for k in ("quoted", "bare", "login") if m[k] is not None)
        a, b = m.span(kind)
        ends = [x.start() for x in _MARKS.finditer(text, a, b)] if kind == "bare" else []
        at = a  # the value's first place outside the fixed spans
        for x, y in fixed:
            if x <= at < y:
                at = y
        if b - a >= 6 and at < b:
            yield a, [*(e for e in ends if e > a), b]


def _chosen(text: str, a: int, ends: list[int], ranks: dict[str, int]) -> int:
    """Where a value ends: it goes on behind a mark if what follows, up to the next one, is neither a field nor a tag and no easy guess by itself."""
    end = ends[0]
    for after in ends[1:]:
        tail = text[end + 1 : after]
        if tail and (_OTHER.match(text, end, ends[-1]) or guess_cost(tail, ranks, _LEAST_TAIL) < _LEAST_TAIL):
            break
        end = after
    return a + len(text[a:end].rstrip(_ENDS))


def _fixed(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def wanted(text: str) -> set[str]:
    """What a text's values may hold of words: all their parts that are letters of a word's length."""
    found = set()
    for start, ends in _values(text, sorted((a, b) for a, _, b in _fixed(text))):
        low = text[start : ends[-1]].lower()
        for form in {low, low.translate(LEET)}:
            for run in re.finditer(r"[^\W\d_]{3,}", form):
                x = run[0]
                found.update(x[i:j] for i in range(len(x) - 2) for j in range(i + 3, min(len(x), i + _MOST_WORD) + 1))
    return found


def scan(text: str, ranks: dict[str, int], least: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    spans = _fixed(text)
    fixed = sorted((a, b) for a, _, b in spans)
    for a, ends in _values(text, fixed):
        b = _chosen(text, a, ends, ranks)
        covered = a
        for x, y in fixed:
            if x <= covered < y:
                covered = y
        if b - a >= 6 and covered < b and guess_cost(text[a:b], ranks, least) >= least:
            spans.append((a, 3, b))
    return sorted(spans)


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a span: a run of 16 hex bytes, AKIA, or a keyword in a text with a separator or 'is'."""
    hit = np.zeros(len(offsets) - 1, bool)
    inside = np.append(_HEX_BYTE[data], False)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets] = inside[offsets]  # a run ends with its row
    ends = np.flatnonzero(np.append(inside[:-1] & (begins[1:] | ~inside[1:]), False)) + 1
    begins = np.flatnonzero(begins)
    places = np.append(begins[ends - begins >= 16], np.array([m.start() for m in _HINTS.finditer(data.tobytes())], np.int64))
    hit[np.searchsorted(offsets, places, "right") - 1] = True
    return np.flatnonzero(hit)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lower-case words of 3 to 24 letters with their counts, a slice of the texts at a time; Spark sums them up before the shuffle."""
    release()
    for batch in batches:
        column = batch.column(0).cast(pa.large_string())
        for a in range(0, len(column), 200):
            parts = pc.list_flatten(pc.utf8_split_whitespace(column.slice(a, 200).drop_null()))
            counted = pc.value_counts(parts)
            word = pc.utf8_lower(pc.utf8_trim(counted.field(0), _TRIMMED))
            size = pc.utf8_length(word)
            keep = pc.and_(pc.utf8_is_alpha(word), pc.and_(pc.greater_equal(size, 3), pc.less_equal(size, _MOST_WORD)))
            table = pa.table({"word": word, "n": counted.field(1)}).filter(keep).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            for out in table.to_batches(50_000):
                yield pa.RecordBatch.from_arrays([out.column(0).cast(pa.string()), out.column(1)], ["word", "n"])


def own_words(text: str) -> list[str]:
    """The words of a text, as they are counted, that are a value."""
    found = []
    for a, ends in _values(text, sorted((x, y) for x, _, y in _fixed(text))):
        b = ends[-1]
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        word = text[a:b].strip(_TRIMMED).lower()
        if word.isalpha() and 3 <= len(word) <= _MOST_WORD:
            found.append(word)
    return found


def _counts(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    words = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(_words), "word string, n long")
    return cut(words.groupBy("word").agg(F.sum("n").alias("n")), "words")


def ranked_words(docs: DataFrame, own: DataFrame) -> DataFrame:
    """word, rank: all words of all texts less the occurrences in ``own`` (word), ranked from 1 by count and word."""
    counts = _counts(docs).union(own.select("word", F.lit(-1).cast("long"))).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    return running(counts, [F.desc("n"), F.col("word")], before=F.lit(1).cast("long")).select("word", (F.col("before") + 1).alias("rank"))


def _found(ranks: dict[str, int] | None, brings: bool, least: float, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[int, list]]]:
    """Slices of the batches with the spans of those rows that have any.

    Without ``ranks``, rows that want any bring their own in the last column, which is
    taken off, if ``brings``; else they are left out.
    """
    release()
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(text_at)):
            part = batch.slice(a, b - a)
            brought = None
            if brings:
                brought = part.column(part.num_columns - 1)
                part = part.select(list(range(part.num_columns - 1)))
            spans, stays = {}, np.ones(b - a, bool)
            for i in _suspects(data, offsets).tolist():
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                own = ranks
                if brought is not None:
                    own = {x["word"]: x["rank"] for x in brought[i].as_py() or ()}
                elif ranks is None and wanted(text):
                    stays[i] = False
                    continue
                if found := scan(text, own or {}, least):
                    spans[i] = found
            if not stays.all():
                place = np.cumsum(stays) - 1
                part, spans = part.filter(pa.array(stays)), {int(place[i]): x for i, x in spans.items()}
            yield part, spans


def _wanting(text_at: int, names: list[str]):
    """The rows that want ranks, with the parts of their values that may be words and their own words, under ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for a, _, data, offsets in slices(batch.column(text_at)):
                rows, words, own = [], [], []
                for i in _suspects(data, offsets).tolist():
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    if w := wanted(text):
                        rows.append(a + i)
                        words.append(sorted(w))
                        own.append(own_words(text))
                if rows:
                    part = batch.take(pa.array(rows))
                    kind = pa.list_(pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words, kind), pa.array(own, kind)], [*part.schema.names, *names])

    return tidy(run)


def _scanned(docs: DataFrame, run, schema: T.StructType, ranks: dict[str, int] | None) -> DataFrame:
    """``run(ranks)`` over all rows; without given ranks, over those that want none and those joined with theirs."""
    ship_package(docs.sparkSession)
    docs = dealt(docs)
    if ranks is not None:
        return docs.mapInArrow(run(docs.sparkSession.sparkContext.broadcast(ranks), False), schema)
    text_at = docs.columns.index("text")
    words, own, row, last = (free_name(docs.columns, c) for c in ("_words", "_own", "_row", "_ranks"))
    lists = [T.StructField(c, T.ArrayType(T.StringType())) for c in (words, own)]
    wanting = docs.mapInArrow(_wanting(text_at, [words, own]), T.StructType([*docs.schema.fields, *lists]))
    wanting = cut(wanting.withColumn(row, F.monotonically_increasing_id()), "wanting")
    ranked = ranked_words(docs, wanting.select(F.explode(own).alias("word")))
    given = wanting.select(F.col(row).alias("row"), F.explode(words).alias("word")).join(ranked, "word")
    given = cut(given.groupBy("row").agg(F.collect_list(F.struct("word", "rank")).alias(last)).withColumnRenamed("row", row), "ranks")
    joined = wanting.join(given, row, "left").select(*[F.col(f"`{c}`") for c in docs.columns], last)
    return docs.mapInArrow(run(None, False), schema).union(joined.mapInArrow(run(None, True), schema))


def _scan(sent, brings: bool, least: float, text_at: int, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for part, spans in _found(sent and sent.value, brings, least, text_at, batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans.get(i, ())] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(kind))], [*part.schema.names, into])

    return tidy(run)


def find_secrets(docs: DataFrame, least: float = 9.0, ranks: dict[str, int] | None = None, into: str = "_spans") -> DataFrame:
    """The rows of ``docs`` (which needs a ``text`` column) with ``into``: array of (kind, start, end), by start and kind."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()])
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    text_at = docs.columns.index("text")
    return _scanned(docs, lambda sent, brings: _scan(sent, brings, least, text_at, into), T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(kind))]), ranks)


def _redact(sent, brings: bool, least: float, text_at: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, spans in _found(sent and sent.value, brings, least, text_at, batches):
            if spans:
                texts = part.column(text_at).to_pylist()
                for i, own in spans.items():
                    out, at = [], 0
                    for start, _, end in own:
                        if end > at:
                            out += [texts[i][at : max(at, start)], mark if start >= at else ""]
                            at = end
                    texts[i] = "".join(out) + texts[i][at:]
                part = part.set_column(text_at, part.schema.field(text_at), pa.array(texts, part.schema.field(text_at).type))
            yield part

    return tidy(run)


def redacted(docs: DataFrame, mark: str = "[SECRET]", least: float = 9.0, ranks: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one)."""
    text_at = docs.columns.index("text")
    return _scanned(docs, lambda sent, brings: _redact(sent, brings, least, text_at, mark), docs.schema, ranks)
