"""Personal data by offset-preserving deobfuscation.

Two passes over every text. The base pass finds identifiers as they are written. The second
pass rewrites disguises by transducers (look-alike and invisible characters, digits spelled
as words, at/dot in words or brackets), keeps for every character of the result where it
came from, finds identifiers in the result, and maps their spans back to the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import each_text
from auditlens.llm.top_level import DELEGATED, RESERVED

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Looking behind spares the search from trying every start inside a long run of digits; a
# start there could only match if the start of the run did.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones, in the order of LATIN.
CYRILLIC, LATIN_OF_CYRILLIC = "аеорсухіјѕһԁԛԝАВЕЗКМНОРСТУХІЈЅ", "aeopcyxijshdqwABE3KMHOPCTYXIJS"
GREEK, LATIN_OF_GREEK = "αινορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivopuxABEZHIKMNOPTYX"
DOTS, HYPHENS, AT_SIGN, PLUS_SIGN = "․·∙•⋅。﹒", "‐‑‒–−﹣", "﹫", "﹢"
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9",
}


def _look_alikes() -> dict[str, str]:
    found = dict(zip(CYRILLIC + GREEK, LATIN_OF_CYRILLIC + LATIN_OF_GREEK, strict=True))
    signs = {".": DOTS, "-": HYPHENS, "@": AT_SIGN, "+": PLUS_SIGN, "": INVISIBLE}
    found |= {c: plain for plain, group in signs.items() for c in group}
    # Full-width forms, circled and mathematical letters and digits, by their compatibility form.
    for low, high in ((0xFF01, 0xFF5E), (0x2460, 0x2468), (0x24B6, 0x24EA), (0x1D400, 0x1D7FF)):
        for code in range(low, high + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain.isascii():
                found[chr(code)] = plain
    for code in (*range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)):
        found[chr(code)] = str(unicodedata.digit(chr(code)))
    return found


LOOK_ALIKES = _look_alikes()
LOOK_ALIKE = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + "]")

_DIGIT = f"(?:{'|'.join(DIGIT_WORDS)})"
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_DOT = rf"(?:{_OPEN}(?:dot|punkt|punto|point|\.){_CLOSE}|\s{{1,3}}dot\s{{1,3}})"
_AT = rf"(?:{_OPEN}(?:at|@|arroba|arobase){_CLOSE}|\s{{1,3}}at\s{{1,3}})"
_LABEL = r"[A-Za-z0-9-]{1,63}"
#: An address in disguise: a name, an at, a label, and at least one dot and label.
DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?:{_DOT}|\.)[A-Za-z0-9_%+-]{{1,64}}){{0,5}}"
    rf"(?:{_AT}|@){_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{1,6}}(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
#: A bare at and a name with its dots as such, which sentences have too ("sold at 3.5").
WRITTEN = re.compile(rf"\sat\s{{1,3}}{_LABEL}(?:\.{_LABEL})+\Z", re.IGNORECASE)
AT, DOT = re.compile(_AT, re.IGNORECASE), re.compile(_DOT, re.IGNORECASE)
_GAP = rf"(?:[\s,-]{{1,3}}|\s{{0,3}}(?:dot|point)\s{{1,3}}|{_DOT}|\.)"
#: Digits as words: at least two in a row, with signs between them also as words. A run is
#: taken whole and given back as far as _ended says, so that no word is the start of many runs.
SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?P<first>(?:plus[\s-]{{1,3}})?(?:{_DIGIT}|[0-9]+))"
    rf"(?:{_GAP}(?:{_DIGIT}|[0-9]+))++",
    re.IGNORECASE,
)
SPELLED_ON = re.compile(rf"{_GAP}(?:{_DIGIT}|[0-9]+)", re.IGNORECASE)
SPELLED_END = re.compile(r"(?![A-Za-z0-9])", re.IGNORECASE)
NUMBER_TOKEN = re.compile(rf"{_DIGIT}|[0-9]+|plus|dot|point|punkt|punto|\.", re.IGNORECASE)
#: What a text must have for SPELLED to be tried: two digits of which one is a word, a plus as
#: a word, or a word or bracket between digits. Whatever SPELLED matches and _number rewrites
#: holds one of these, so trying it first never loses a match.
_WORD_GAP = rf"(?:\s{{0,3}}(?:dot|point)\s{{1,3}}|{_DOT})"
SPELLED_HINT = re.compile(
    rf"{_DIGIT}{_GAP}(?:{_DIGIT}|[0-9])|[0-9](?:{_GAP}{_DIGIT}|{_WORD_GAP}[0-9])"
    rf"|plus[\s-]{{1,3}}(?:{_DIGIT}|[0-9])",
    re.IGNORECASE,
)
#: What DISGUISED matches has this in its middle: the at, a label, and the next label's start.
DISGUISED_HINT = re.compile(rf"(?:{_AT}|@){_LABEL}(?:{_DOT}|\.)[A-Za-z0-9-]", re.IGNORECASE)
#: Ends of names that a disguise made of bare words only must have.
TOP_LEVEL = DELEGATED | RESERVED
#: "Look at the dot now": a bare dot after one of these is a dot on something, unless what
#: follows is hardly ever a word of its own.
DETERMINERS = frozenset("a an any each every his her its my no our that the their this your".split())
AFTER_DETERMINER = frozenset(
    "com org net edu gov mil int info biz io co de fr es uk eu ch nl pl pt se dk ru "
    "cn jp br mx ar au ca example test".split()
)


def emails(text: str) -> Iterator[Span]:
    done = 0
    for match in DOMAIN.finditer(text):
        at = match.start()
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield start, done


def ips(text: str) -> Iterator[Span]:
    for match in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.group().split(".")):
            yield match.span()


def passes_luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for match in DIGITS.finditer(text):
        if match.end() - match.start() >= 13:
            digits = match.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[Span]:
    for match in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in match.group()) <= 15:
            yield match.span()


FIND: dict[str, Callable[[str], Iterator[Span]]] = {
    "email": emails, "ip": ips, "card": cards, "phone": phones
}


class Tape:
    """A text being rewritten, with the source span of every character."""

    def __init__(self, text: str):
        self.text, self.first, self.end = text, None, None

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[int, int, str]]]):
        """by() gives (start, end, new) edits inside a match, in order."""
        edits = [edit for match in pattern.finditer(self.text) for edit in by(match)]
        if not edits:
            return
        first = self.first or range(len(self.text))
        end = self.end or range(1, len(self.text) + 1)
        text, begins, ends, done = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[done:a], new]
            begins += [*first[done:a], *[first[a]] * len(new)]
            ends += [*end[done:a], *[end[b - 1]] * len(new)]
            done = b
        text.append(self.text[done:])
        self.first, self.end = [*begins, *first[done:]], [*ends, *end[done:]]
        self.text = "".join(text)

    def source(self, span: Span) -> Span:
        return self.first[span[0]], self.end[span[1] - 1]


def _address(match: re.Match) -> list[tuple[int, int, str]]:
    """Only the ats and dots of a disguised address are rewritten; the last at counts.

    One of bare words only must end in a top-level name. With a bracket, a sign or a dot in
    the name before the at it may end in anything.
    """
    start, whole = match.start(), match.group()
    words = whole.replace(" ", "").isalnum()
    if words or WRITTEN.search(whole):
        labels = re.split(r"[\s.]+", whole.lower())
        on_something = words and labels[-3] in DETERMINERS
        if labels[-1] not in (AFTER_DETERMINER if on_something else TOP_LEVEL):
            return []
    ats = list(AT.finditer(whole))
    edits = [(m.start(), m.end(), "@") for m in ats[-1:]] if "@" not in whole else []
    if not edits and "@" in whole:
        edits = [(m.start(), m.end(), "@") for m in ats if "@" in m.group()]
    taken = [e[:2] for e in edits]
    for m in DOT.finditer(whole):
        if all(m.end() <= a or m.start() >= b for a, b in taken):
            edits.append((m.start(), m.end(), "."))
    return [(start + a, start + b, new) for a, b, new in sorted(edits)]


def _ended(match: re.Match) -> int:
    """Where a run of digits ends: behind its last one that no letter or digit follows.

    The first one alone is no run.
    """
    end, text = match.start(), match.string
    for digit in SPELLED_ON.finditer(text, match.end("first"), match.end()):
        if SPELLED_END.match(text, digit.end()):
            end = digit.end()
    return end


def _number(match: re.Match) -> list[tuple[int, int, str]]:
    """Digits in a row, signs as such. A run without words or brackets stays as it is."""
    start = match.start()
    whole = match.string[start : _ended(match)]
    if not re.search(r"[A-Za-z\[({<]", whole):
        return []
    edits = []
    for token in NUMBER_TOKEN.finditer(whole):
        word = token.group().lower()
        new = DIGIT_WORDS.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word, word)
        edits.append((token.start(), token.end(), new))
    out, done = [], 0
    for a, b, new in edits:  # what stands between tokens goes
        if a > done:
            out.append((start + done, start + a, ""))
        out.append((start + a, start + b, new))
        done = b
    return out


#: Look-alikes that Latin-1 has too: the middle dot and the soft hyphen.
LATIN_1 = tuple(c.encode("latin-1") for c in LOOK_ALIKES if ord(c) < 256)


def _latin(text: str) -> bool:
    """Whether a text surely has no look-alikes, seen without a search."""
    if text.isascii():
        return True
    try:
        encoded = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in encoded for c in LATIN_1)


def deobfuscated(text: str) -> Tape | None:
    """The text with disguises undone, or None where it has none.

    What is asked before a pattern is tried holds for every text that the pattern can change,
    so other passages of a text never decide whether a disguise is undone.
    """
    tape = Tape(text)
    if not _latin(text):
        tape.rewrite(LOOK_ALIKE, lambda m: [(*m.span(), LOOK_ALIKES[m.group()])])
    if SPELLED_HINT.search(tape.text):
        tape.rewrite(SPELLED, _number)
    if DISGUISED_HINT.search(tape.text):
        tape.rewrite(DISGUISED, _address)
    return tape if tape.first is not None else None


def find_spans(text: str) -> tuple[list[tuple], list[tuple]]:
    """(base spans, all spans), each as (kind, start, end) by kind, then start.

    A span that the second pass finds is left out where it meets a base span of its kind.
    """
    tape = deobfuscated(text)
    base, every = [], []
    for kind in KINDS:
        plain = list(FIND[kind](text))
        base += [(kind, *s) for s in plain]
        undone = map(tape.source, FIND[kind](tape.text)) if tape else ()
        starts = [a for a, _ in plain]
        for span in undone:  # base spans are in order and apart, and so are these
            before = bisect_left(starts, span[1]) - 1
            if before < 0 or plain[before][1] <= span[0]:
                every.append((kind, *span))
        every += [(kind, *s) for s in plain]
    every.sort(key=lambda s: (KINDS.index(s[0]), s))
    return base, every


def _make() -> Callable:
    def one(text: str) -> tuple:
        base, every = find_spans(text)
        as_dicts = lambda found: [dict(zip(("kind", "start", "end"), s)) for s in found]
        return as_dicts(base), as_dicts(every)

    return lambda texts: map(one, texts)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `pii`: struct<base, spans> to every row, and keeps the rest.

    base are the spans found as written, spans these and the ones in disguise. Offsets are
    code points, ends exclusive. An address in bare words ("jane at mail dot dev") must end in
    a top-level name (`top_level`). Null and empty texts have none. Rows are independent:
    repeated rows give repeated results, an empty table an empty one. A column `pii` of the
    input is replaced.
    """
    schema = f"base {SPANS}; spans {SPANS}"
    return docs.withColumn("pii", each_text(_make, schema)(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of personal data by its kind in brackets, e.g. [email].

    Where spans of two kinds meet, one replacement, of the first one's kind, covers both.
    Null stays null.
    """
    found = personal_data(docs, text)
    ordered = F.array_sort(F.transform("pii.spans", lambda s: F.struct(s.start, s.end, s.kind)))
    none = F.struct(F.lit("").alias("out"), F.lit(0).alias("done"))
    merged = F.aggregate(
        ordered,
        none,
        lambda acc, s: F.when(
            s["start"] >= acc["done"],
            F.struct(
                F.concat(
                    acc["out"],
                    F.col(text).substr(acc["done"] + 1, s["start"] - acc["done"]),
                    F.lit("["),
                    s["kind"],
                    F.lit("]"),
                ).alias("out"),
                s["end"].alias("done"),
            ),
        ).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))
        ),
    )
    return (
        found.withColumn("pii", merged)
        .withColumn(
            text,
            F.when(F.col("pii.done") == 0, F.col(text)).otherwise(
                F.concat("pii.out", F.col(text).substr(F.col("pii.done") + 1, F.length(text)))
            ),
        )
        .drop("pii")
    )


def _joined(spans: Column) -> Column:
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end))
    )


def pii_digests(docs: DataFrame) -> DataFrame:
    """Per document the base counts by kind, the base spans' digest, and all spans."""
    found = personal_data(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii.base", lambda s: s.kind == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_joined(F.col("pii.base")), 256).alias("base_sha256"),
        _joined(F.col("pii.spans")).alias("spans"),
    )
