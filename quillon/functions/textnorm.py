"""Text normalisation as Column expressions.

Normalising lowers case and strips combining marks for each character, makes a run of white space one blank, and trims.
Folding maps single code points, so it is one ``translate``; the few code points that become two (Tibetan) stay as they are.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words (Unicode's, and the four separators U+001C to U+001F).
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The same as a character class for Java's and RE2's patterns.
WHITE_CLASS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def stripped(char: str) -> str:
    """A character without its combining marks."""
    parts = unicodedata.normalize("NFD", char)
    return unicodedata.normalize("NFC", "".join(c for c in parts if not unicodedata.combining(c)))


@lru_cache(4)
def fold_map(lower: bool, white: bool) -> tuple[str, str]:
    """What ``translate`` replaces, by what; characters beyond the second string's end are deleted."""
    changed, deleted = [], []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        to = " " if white and char in WHITE else stripped(char.lower() if lower else char)
        if to != char:
            if len(to) == 1:
                changed.append((char, to))
            elif not to:
                deleted.append(char)
    return "".join(a for a, _ in changed) + "".join(deleted), "".join(b for _, b in changed)


def fold(text: Column) -> Column:
    """Lower case, no marks, each white space character a blank; runs stay."""
    return F.translate(text, *fold_map(True, True))


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), " +", " "))


def strip_accents(text: Column) -> Column:
    """No marks; case and white space stay."""
    return F.translate(text, *fold_map(False, False))


def stripped_text(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, rf"\A[{WHITE_CLASS}]+|[{WHITE_CLASS}]+\z", "")


def index_map(text: Column) -> Column:
    """For each character of the normalised text, its index in the text; a blank has its run's first."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(fold(c).alias("c"), i.alias("i")))
    kept = F.filter(chars, lambda x: x["c"] != "")
    # Each run of blanks keeps its first: drop a blank whose predecessor is one.
    once = F.transform(F.array(kept), lambda all_: F.filter(all_, lambda x, k: (x["c"] != " ") | (k == 0) | (F.element_at(all_, F.greatest(k, F.lit(1))).getField("c") != " ")))[0]
    words = F.transform(F.array(once), lambda all_: F.filter(all_, lambda x, k: (x["c"] != " ") | ((k > 0) & (k < F.size(all_) - 1))))[0]
    return F.transform(words, lambda x: x["i"])


def original_offset(index: Column, offset: Column) -> Column:
    """The text's offset of a normalised one: 0 before the start, one beyond the last character past the end."""
    return F.when((offset < 0) | (F.size(index) == 0), F.lit(0)).when(offset < F.size(index), F.get(index, offset)).otherwise(F.element_at(index, -1) + 1)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def without_punctuation(normalised: Column) -> Column:
    """Of the same length, anything but letters and numbers a blank."""
    return F.regexp_replace(normalised, r"[^\p{L}\p{N} ]", " ")


def letter_words(normalised: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normalised, r"[^\p{L}]+", " "), " "), lambda w: w != "")


#: Card numbers, spelled-out passwords, bearer tokens.
SENSITIVE = (r"(?U)\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"(?iU)minha\s+senha\s+(?:é|eh)\s+\S+", r"(?i)bearer\s+[a-z0-9\-._~+/]+=*")
REDACTED = "[REDACTADO]"


def redact(text: Column) -> Column:
    for pattern in SENSITIVE:
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def gate(text: Column, least: int, most: int) -> Column:
    """Why a message is not looked at, or null: empty, too_short, too_long (of the stripped text)."""
    n = F.length(stripped_text(text))
    return F.when(text.isNull() | (n == 0), "empty").when(n < least, "too_short").when(n > most, "too_long")


#: First words of character names and the script each stands for; other letters are of an unknown one.
SCRIPT_NAMES = {"LATIN": "Latin", "CJK": "CJK", "HIRAGANA": "CJK", "KATAKANA": "CJK", "HANGUL": "CJK", "CYRILLIC": "Cyrillic", "ARABIC": "Arabic"}


@lru_cache(1)
def script_classes() -> dict[str, str]:
    """For each script, the body of a character class with its letters, from the characters' names."""
    runs: dict[str, list[list[int]]] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            script = SCRIPT_NAMES.get(unicodedata.name(char, "").split(" ")[0].split("-")[0])
            if script:
                own = runs.setdefault(script, [])
                if own and own[-1][1] == code - 1:
                    own[-1][1] = code
                else:
                    own.append([code, code])
    return {script: "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in own) for script, own in runs.items()}


def letters_of(text: Column, body: str) -> Column:
    """How many characters are in a class."""
    return F.length(F.regexp_replace(text, f"[^{body}]", ""))
