"""Text of recognised lines and of file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.numbers import cascade, clamp, col

# fixed values: white space as regular expressions of the reference understand it, and its patterns
BLANK = r"[\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LETTER = r"[가-힣A-Za-z]"
DIGITS = r"^[0-9]+$"
PAGE_NUMBER = rf"^(?i:page{BLANK}*)?[0-9]+(?:{BLANK}*/{BLANK}*[0-9]+)?$"
DATE = rf"^[0-9]{{4}}[./년-]{BLANK}*[0-9]{{1,2}}(?:[./월-]{BLANK}*[0-9]{{1,2}}일?)?$"
SENTENCE_END = r"[.!?。]$"
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'
TITLE_LENGTH, NAME_LENGTH, TALLEST = 50, 120, 0.2


def units(text: Column) -> Column:
    """Length in UTF-16 units, as the reference counts."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def collapsed(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, rf"{BLANK}+", " "))


def is_meaningful(line: Column, n: Column | None = None) -> Column:
    """Two characters or more with a letter, and neither a number, a page number nor a date.  ``n``: the line's units, where they are known."""
    return ((units(line) if n is None else n) >= 2) & line.rlike(LETTER) & ~line.rlike(DIGITS) & ~line.rlike(PAGE_NUMBER) & ~line.rlike(DATE)


def looks_like_sentence(line: Column, n: Column | None = None) -> Column:
    return ((units(line) if n is None else n) > 40) | line.rlike(SENTENCE_END)


def title_score(line: Column, top: Column, height: Column | float = 0.0, confidence: Column | float = 0.5, n: Column | None = None) -> Column:
    """Rank of a line as title: high on the page, tall (a fifth of the page at most), of a phrase's length, certain, and no sentence."""
    n = units(line) if n is None else n
    length = cascade(((n >= 4) & (n <= 36), F.lit(1.4)), (n <= TITLE_LENGTH, F.lit(0.7)), otherwise=F.lit(0.1))
    sentence = F.when(looks_like_sentence(line, n), F.lit(0.8)).otherwise(F.lit(0.0))
    return (F.lit(1.0) - top) * 4.0 + clamp(height, 0.0, TALLEST) * 45.0 + length + F.coalesce(col(confidence), F.lit(0.5)) * 0.4 - sentence


def head(text: Column, length: int) -> Column:
    """The first ``length`` UTF-16 units; a character that would be cut in two is left out."""
    coded = F.encode(text, "UTF-16BE")
    last = F.hex(F.substring(coded, 2 * length - 1, 1))
    whole = F.when(last.between("D8", "DB"), 2 * length - 2).otherwise(2 * length)
    return F.when(F.length(text) <= length // 2, text).otherwise(F.decode(F.substring(coded, F.lit(1), whole), "UTF-16BE"))


def truncated(text: Column, length: int = TITLE_LENGTH) -> Column:
    """At most ``length`` UTF-16 units; cut at the last space if that is past the middle."""
    start = head(text, length + 1)
    before = F.regexp_extract(start, r"(?s)^(.*) ", 1)
    cut = F.when((F.instr(start, " ") > 0) & (units(before) >= length // 2), before).otherwise(head(text, length))
    return F.when(units(text) <= length, text).otherwise(F.regexp_replace(cut, rf"{BLANK}+$", ""))


def safe_base_name(text: Column) -> Column:
    """Forbidden characters as underscores, no dots or spaces at the end, white space collapsed."""
    return collapsed(F.regexp_replace(F.regexp_replace(text, FORBIDDEN, "_"), r"[. ]+$", ""))


def safe_file_name(text: Column) -> Column:
    """A file name ending in .pdf; null where nothing is left, which the reference reports as an error."""
    value = trimmed(text)
    value = F.when(F.lower(value).endswith(".pdf"), trimmed(F.substring(value, F.lit(1), F.length(value) - 4))).otherwise(value)
    value = safe_base_name(value)
    value = F.when(units(value) > NAME_LENGTH, F.regexp_replace(head(value, NAME_LENGTH), rf"{BLANK}+$", "")).otherwise(value)
    return F.when(value != "", F.concat(value, F.lit(".pdf")))


def default_name(time: Column, prefix: str = "Scan") -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.date_format(time, "yyyyMMdd_HHmm"))


def safe_stem(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def language(tag: Column) -> Column:
    """Null for empty and undetermined tags."""
    return F.when(~trimmed(tag).isin("", "und"), tag)


def is_safe_path(path: Column) -> Column:
    """Relative, already normalised, and not leaving its folder."""
    return (path != "") & ~path.rlike(r"^/|^[A-Za-z]:|\\") & ~path.rlike(r"(^|/)\.\.?(/|$)") & ~path.rlike(r"//|/$")


def title_top(order: Column, top: Column | None = None, page_height: Column | None = None) -> Column:
    """Place on the page, 0 to 1: from the box if there is one, else from the reading order."""
    by_order = clamp(order / F.lit(20.0))
    return by_order if top is None else F.when(top.isNull() | (page_height <= 0), by_order).otherwise(clamp(top / page_height))
