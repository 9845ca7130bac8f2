"""Column functions on text: page checks, normalization, unwrapping, chunks, sentences, keys, entities."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Phrases of bot-challenge pages.
CHALLENGE_MARKERS = (
    "cf-browser-verification",
    "cf_challenge",
    "checking your browser",
    "just a moment...",
    "attention required",
    "captcha",
    "are you a robot",
)
# Line ends that close a paragraph, and determiners that an entity loses.
UNWRAP_CLOSERS = ".!?\"':;"
DETERMINERS = ("the", "a", "an", "his", "her", "its", "their")
# Words that are no entities.
PRONOUNS = ("this", "that", "these", "those", "there", "here", "it", "he", "she", "they", "we", "you", "i", "one", "someone", "something", "anything", "nothing", "everyone")


# Line breaks and white space as the Unicode standard lists them, as regular expressions that Java and RE2 read alike.
BREAKS = r"\x0D\x0A|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same, apart: characters that break a line, and white space within one.
IN_BREAKS, IN_LINE = r"\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}", r"\x09\x1F\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"


def lines(text: Column) -> Column:
    """Lines at any line break."""
    return F.split(text, BREAKS, -1)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_challenge(text: Column) -> Column:
    """Whether a page is a bot challenge instead of content."""
    low = F.lower(text)
    out = F.lit(False)
    for marker in CHALLENGE_MARKERS:
        out = out | low.contains(marker)
    return out


def strip_boilerplate(text: Column) -> Column:
    """Text between the start and end markers of an ebook; unchanged without a start marker."""
    start = r"(?is)^.*?\*\*\* ?start of (?:the|this) project[^\n]*?\*\*\*"
    end = r"(?is)\*\*\* ?end of (?:the|this) project.*$"
    return F.when(text.rlike(start), F.trim(F.regexp_replace(F.regexp_replace(text, start, ""), end, ""))).otherwise(text)


#: Characters that UTF-8 bytes above 127 become when they are read as cp1252, or as Latin-1 where cp1252 has none.
_AS_READ = {bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b): b for b in range(128, 256)} | {chr(b): b for b in range(128, 160)}
_TAIL = "[" + "".join(re.escape(c) for c, b in _AS_READ.items() if b < 0xC0) + "]"
#: UTF-8 that was read so: accented Latin letters, signs and punctuation, pictographs, replacement and byte-order marks, runs of Cyrillic.
_misread = re.compile(f"Ã{_TAIL}|Â(?=[\u00a0-\u00bf]){_TAIL}|â[€\u0080‚ƒ„]{_TAIL}|ðŸ{_TAIL}{{2}}|ï¿½|ï»¿|(?:[ÐÑ]{_TAIL}){{2,}}")
_entity = re.compile("&#?[0-9A-Za-z]{1,24};")
_escape = re.compile("\x1b\\[[0-9;]*[A-Za-z]")
_control = re.compile("[\x00-\x08\x0e-\x1b\x7f\u206a-\u206f\ufeff\ufff9-\ufffc]")
_odd = re.compile("[&\x00-\x08\x0e-\x1b\x7f-\uffff]")
_wide = re.compile("[\ufb00-\ufb06\uff01-\uffef\u3000]+")
_quotes = {0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201B: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"', 0x201F: '"'}


def _reread(m: re.Match) -> str:
    try:
        return bytes(_AS_READ[c] for c in m[0]).decode()
    except (KeyError, UnicodeDecodeError):
        return m[0]


def repair(text: str) -> str:
    """Damage undone: text decoded with the wrong table, escaped entities (in texts without markup), curly quotes, ligatures and wide forms, terminal codes, control characters; then canonical composition."""
    if _odd.search(text):
        if "<" not in text:
            text = _entity.sub(lambda m: html.unescape(m[0]), text)
        text = _escape.sub("", text)
        for _ in range(3):  # read wrongly more than once
            again = _misread.sub(_reread, text)
            if again == text:
                break
            text = again
        text = _wide.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text.translate(_quotes))
        text = _control.sub("", text)
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """:func:`repair` of each text; Spark has no such function."""
    return texts.map(lambda t: None if t is None else repair(t))


def normalize(text: Column, compose: bool = True) -> Column:
    """Per line: white space to single spaces, trimmed; empty lines go. ``compose`` repairs and composes characters first."""
    each = F.transform(lines(repaired(text) if compose else text), lambda x: F.trim(F.regexp_replace(x, f"{SPACE}+", " ")))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def unwrap(text: Column) -> Column:
    """Joins hard-wrapped lines of a normalized text, unless a line ends a sentence or quotation."""
    return F.regexp_replace(text, r"(?<![.!?\"':;])\n", " ")


def chunks(text: Column, max_chars: int) -> Column:
    """Greedy packing of lines into chunks; each line counts one more than its length, and a long line stays whole."""
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"), F.lit(True).alias("empty"))

    def add(s: Column, line: Column) -> Column:
        full = ~s["empty"] & (s["size"] + F.length(line) + 1 > max_chars)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full | s["empty"], line).otherwise(F.concat(s["open"], F.lit("\n"), line)).alias("open"),
            F.when(full, F.length(line) + 1).otherwise(s["size"] + F.length(line) + 1).alias("size"),
            F.lit(False).alias("empty"),
        )

    finish = lambda s: F.when(s["empty"], s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    parts = F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(none)
    return F.aggregate(parts, state, add, finish)


def doc_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sentences(text: Column) -> Column:
    """Pieces after a stop followed by white space."""
    return F.split(text, r"(?<=[.!?])\s+", -1)


def url_domain(url: Column) -> Column:
    """Host with its port, colons as underscores."""
    return F.translate(F.parse_url(url, F.lit("AUTHORITY")), ":", "_")


def url_key(url: Column) -> Column:
    return F.substring(F.sha2(url.cast("binary"), 256), 1, 12)


def normalize_entity(span: Column, lemma: Column | None = None) -> Column:
    """Lower case without leading determiners; the head's lemma instead, where it has more than two letters and may be an entity."""
    base = F.trim(F.regexp_replace(F.lower(F.trim(span)), "^((" + "|".join(DETERMINERS) + ")( +|$))+", ""))
    if lemma is None:
        return base
    low = F.trim(F.lower(lemma))
    return F.when((F.length(low) > 2) & ~low.isin(*PRONOUNS), low).otherwise(base)


def is_valid_entity(entity: Column) -> Column:
    return F.length(entity).between(2, 60) & ~entity.isin(*PRONOUNS) & entity.rlike(r"[\p{L}\p{N}]")


def pattern_text(page: Column) -> Column:
    """Readable text of a page without a parser: furniture and markup removed, block ends to newlines."""
    x = F.regexp_replace(page, r"(?is)<(script|style|nav|footer|aside|form|noscript|head)\b[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|article|section|main|h[1-6]|ul|ol|li|table|tr|td|th|blockquote|pre|br)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return normalize(x, compose=False)


def tag_free_text(page: Column) -> Column:
    """All text of a page outside scripts and styles: the fallback where nothing else finds any."""
    x = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return normalize(F.regexp_replace(x, r"<[^>]*>", "\n"), compose=False)


def extract_main(page: Column, primary: Callable[[Column], Column] = pattern_text, fallback: Callable[[Column], Column] | None = None) -> Column:
    """Text of a page by ``primary``, or by ``fallback`` where that gives none; null for challenge pages and where both give none.

    Either takes and gives a column. A function that may fail on a page is wrapped by :func:`guarded`.
    """
    found = lambda make: F.nullif(strip(make(page)), F.lit(""))
    text = found(primary) if fallback is None else F.coalesce(found(primary), found(fallback))
    return F.when(~is_challenge(page), text)


def guarded(extract: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """An extractor column from a Python function of one page; a page on which it fails gives null, so the fallback is asked."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        def one(page):
            try:
                return None if page is None else extract(page)
            except Exception:  # noqa: BLE001  whatever an extractor raises, the next one is asked
                return None

        return pages.map(one)

    return run
