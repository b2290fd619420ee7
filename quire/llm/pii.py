"""Personal data with offset-preserving deobfuscation.

Base spans come from the plain text. Then transducers rewrite the text (homoglyphs and invisible characters, spelled
digits, at/dot disguises); each output character keeps the source span it stands for. Identifiers found in the rewritten
text are mapped back to source characters and added where no base span of their kind contains them.

All positions are code points, ends exclusive. Every scan is linear in the text's length: an e-mail is looked for at each
@ only, a disguised one to both sides of each at, and digit patterns start at the first digit of a run, where they match if
they match anywhere in it.

Defined results: null and empty texts have no spans; ids may be null or repeat, each row gives a row; extra columns are
not read by find() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import arrow_pass

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the contract, with possessive repeats where nothing could be given back.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts (and a full stop) that look like an ASCII character, Cyrillic, Greek, Armenian, Latin.
_LOOKALIKE = dict(
    zip(
        "аАвВсСеЕԁԍһНіІјЈкКӏмМпоОрРԛгѕЅтТуУѵԝхХ" + "αΑΒΕΗΙιΚκΜΝνοΟΡρΤυΥΧΖ" + "օսոհց" + "ɑɡı" + "。",
        "aAbBcCeEdGhHiIjJkKlmMnoOpPqrsStTyYvwxX" + "aABEHIiKkMNvoOPpTuYXZ" + "ounhg" + "agi" + ".",
        strict=True,
    )
)
_ODD = re.compile(r"[^\x00-\x9f\xa1-\xac\xae-\xb1\xb4-\xb8\xba-\xff]")

_NUMBER = {w: str(i) for i, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))} | {"oh": "0"}
_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|oh"
_SPELLED_RUN = re.compile(rf"(?i)(?<![a-z])(?:plus[ -])?(?:(?:{_WORDS}|dot|point|[0-9]+)[ .,()-]{{0,3}}){{4,}}(?![a-z])")
_SPELLED = re.compile(rf"(?i)(plus)[ -]|[ ]?(dot|point)[ ]?|({_WORDS})|(, |,)")
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_TOD = r"(?:\s*[\])}>]\s*(?:tod|\.)\s*[\[({<]\s*|\s+tod\s+|\.)"  # of the reversed text
_AT_MARK = re.compile(r"(?i)[\[({<]\s*(?:at|@)\s*[\])}>]|(?<=\s)at(?=\s)|@")
_AFTER_AT = re.compile(rf"(?i)\s*([A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+)")
_GAP = re.compile(r"\s*")
_LOCAL_LABEL = re.compile(r"[A-Za-z0-9_%+-]++")
_BACK_DOT = re.compile(rf"(?i){_TOD}(?=[A-Za-z0-9_%+-])")
_PLAIN_DOTS = re.compile(rf"(?i){_DOT}")
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]")
_MARK = re.compile(rf"{_BRACKETED.pattern}|\sdot\s|\s@\s")
_NUMBER_DOT = re.compile(r"(?i)(?<=[0-9])\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*(?=[0-9])")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """Base spans of a text: (kind's place in KINDS, start, end), ordered."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


class Rewritten:
    """A text under rewriting; character i of it stands for source[start[i]:end[i]]."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = False

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: ordered (from, to, new text) without overlaps."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]
        self.changed = True


def _plain(ch: str) -> str:
    """The ASCII character that a homoglyph stands for, '' for an invisible one, else the character."""
    if ch in _LOOKALIKE:
        return _LOOKALIKE[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf":
        return ""
    if kind in ("Nd", "No") and (d := unicodedata.digit(ch, None)) is not None:
        return str(d)
    if kind in ("Pd", "Zs"):
        return "-" if kind == "Pd" else " "
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() else ch


def fold_homoglyphs(r: Rewritten) -> None:
    r.replace([(m.start(), m.end(), new) for m in _ODD.finditer(r.text) if (new := _plain(m[0])) != m[0]])


def fold_spelled(r: Rewritten) -> None:
    edits = []
    for run in _SPELLED_RUN.finditer(r.text):
        if not any(c.isalpha() for c in run[0]):
            continue
        for m in _SPELLED.finditer(r.text, *run.span()):
            new = "+" if m[1] else "." if m[2] else _NUMBER[m[3].lower()] if m[3] else " "
            edits.append((*m.span(), new))
    r.replace(edits)


def _disguised(text: str):
    """(start, end, start and end of its at) of each address, with or without disguises, in order and without overlaps."""
    back, n, done = text[::-1], len(text), 0
    for mark in _AT_MARK.finditer(text):
        if mark.start() < done:
            continue
        domain = _AFTER_AT.match(text, mark.end())
        if not domain:
            continue
        # labels and dots before the at, read backwards; the farthest label that nothing of an address precedes is the first
        stop, start = n - done, None
        at = gap = _GAP.match(back, n - mark.start(), stop).end()
        while label := _LOCAL_LABEL.match(back, at, stop):
            at = label.end()
            if at == n or back[at] != "." and not _LOCAL.match(back, at):
                start = n - at
            dot = _BACK_DOT.match(back, at, stop)
            if not dot:
                break
            at = dot.end()
        if start is not None:
            done = domain.end()
            yield start, done, n - gap, domain.start(1)


def fold_disguises(r: Rewritten) -> None:
    r.replace([(*m.span(), ".") for m in _NUMBER_DOT.finditer(r.text)])
    edits = []
    for start, end, a, b in _disguised(r.text):
        if not _MARK.search(r.text, start, end):
            continue
        before, after = ([(*x.span(), ".") for x in _PLAIN_DOTS.finditer(r.text, *part)] for part in ((start, a), (b, end)))
        edits += [*before, (a, b, "@"), *after]
    r.replace([e for e in edits if r.text[e[0] : e[1]] != e[2]])


def find_spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each ordered by kind and start."""
    if not text:
        return [], []
    base = detect(text)
    r = Rewritten(text) if _ODD.search(text) else None
    if r:
        fold_homoglyphs(r)
    low = (r.text if r else text).lower()
    # what a disguise needs; neither search leaves out a text that the transducers would change
    dots = "dot" in low or ("@" in low and _MARK.search(low)) or _BRACKETED.search(low)
    numbers = ("dot" in low or "point" in low or any(w in low for w in _NUMBER)) and _SPELLED_RUN.search(low)
    if not (r or numbers or dots):
        return base, base
    r = r or Rewritten(text)
    if numbers:
        fold_spelled(r)
    if dots:
        fold_disguises(r)
    if not r.changed:
        return base, base
    extra = []
    for kind, a, b in detect(r.text):
        s, e = r.start[a], r.end[b - 1]
        if not any(k == kind and x <= s and e <= y for k, x, y in base):
            extra.append((kind, s, e))
    return base, sorted([*base, *extra])


def _digest(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: (doc_id, spans: array of (kind, start, end, base))."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))])

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                base, every = find_spans(t)
                have = set(base)
                out.append([{"kind": KINDS[k], "start": x, "end": y, "base": (k, x, y) in have} for k, x, y in every])
            yield tk.batch(schema, doc_id=b.column(0), spans=out)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans as text."""
    text = lambda cond: F.array_join(F.transform(F.filter("spans", cond), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(lambda s: s["base"]), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"))


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, a, b in find_spans(text)[1])
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i][0], -spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, -spans[i][1])
            i += 1
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data replaced and, if given, the length column (in characters) of changed texts renewed."""
    i = docs.columns.index(text_col)
    k = docs.columns.index(length_col) if length_col else None

    def run(batches):
        for b in batches:
            old = b.column(i).to_pylist()
            new = [redact_text(t) for t in old]
            cols = list(b.columns)
            cols[i] = pa.array(new, b.schema.field(i).type)
            if k is not None:
                had = b.column(k).to_pylist()
                cols[k] = pa.array([n if x == y else len(y) for n, x, y in zip(had, old, new, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return arrow_pass(docs, run, docs.schema)
