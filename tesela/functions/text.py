"""Normalisation of names, keys, amounts and identifiers as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose to one ASCII letter, and these letters."""
    a, b = [], []
    for c in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        flat = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        if len(flat) == 1 and ord(flat) < 128:
            a.append(chr(c))
            b.append(flat)
    return "".join(a), "".join(b)


def ascii_fold(c: Column) -> Column:
    """Accents removed, characters outside ASCII dropped. Null stays null."""
    a, b = _fold_table()
    return F.regexp_replace(F.translate(c, a, b), r"[^\x00-\x7F]", "")


def norm_text(c: Column) -> Column:
    """Matching form: capitals without blanks and accents; letters, digits and ] ^ _ / \\ are kept, hyphens are not."""
    return F.regexp_replace(ascii_fold(F.regexp_replace(F.upper(c), r"\s+", "")), r"[^A-Z0-9\]\^_/\\]", "")


def norm_date(c: Column) -> Column:
    """The first eight digits."""
    return F.substring(F.regexp_replace(c, r"\D", ""), 1, 8)


def text_key(c: Column) -> Column:
    """Capitals and digits in words parted by one blank."""
    return F.trim(F.regexp_replace(F.upper(ascii_fold(c)), r"[^A-Z0-9]+", " "))


def unit_key(c: Column) -> Column:
    """As text_key, without blanks."""
    return F.regexp_replace(F.upper(ascii_fold(c)), r"[^A-Z0-9]+", "")


def stable_key(c: Column) -> Column:
    """Node key: words joined by underscores; UNKNOWN where nothing is left."""
    k = F.regexp_replace(F.upper(ascii_fold(F.coalesce(c, F.lit("")))), r"[^A-Z0-9]+", "_")
    k = F.regexp_replace(k, "^_+|_+$", "")
    return F.when(k == "", F.lit("UNKNOWN")).otherwise(k)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def excerpt(c: Column, length: int = 500) -> Column:
    t = squeeze(c)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, length - 3)), F.lit("...")))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def or_null(c: Column) -> Column:
    return F.when(~blank(c), F.trim(c))


def european_amount(c: Column) -> Column:
    """'1.514.342,42 euros' to a number; null where there is none."""
    t = F.regexp_replace(F.regexp_replace(c, r"[^0-9,.\-]", ""), r"\.", "")
    return F.replace(t, F.lit(","), F.lit(".")).try_cast("decimal(20,4)").cast("double")


def decimal_amount(c: Column) -> Column:
    """Text with a decimal point or comma to a number."""
    return F.replace(F.regexp_replace(c, r"[^0-9.,\-]", ""), F.lit(","), F.lit(".")).try_cast("double")


def cpv_codes(c: Column) -> Column:
    """Distinct eight-digit codes in order of writing."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\d{8})\b"), F.lit(1)))


def main_cpv(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?<!\d)(\d{8})(?!\d)", 1), F.lit(""))


def notice_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "id=([^&#]+)", 1), F.lit(""))


def joined_key(*parts: Column) -> Column:
    """Parts joined by pipes; repeated and outer pipes go; null where nothing is left."""
    k = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    k = F.regexp_replace(F.regexp_replace(k, r"\|{2,}", "|"), r"^\|+|\|+$", "")
    return F.nullif(k, F.lit(""))


def short_hash(prefix: str, n: int, *parts: Column) -> Column:
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, n))


def valid_tax_id(c: Column) -> Column:
    """Whether a Spanish tax identifier has the right check character (person, foreigner or company)."""
    t = F.regexp_replace(F.upper(c), r"[\s\-]", "")
    letters = F.lit("TRWAGMYFPDXBNJZSQVHLCKE")
    person = F.substring(letters, F.substring(t, 1, 8).try_cast("int") % 23 + 1, F.lit(1)) == F.substring(t, 9, 1)
    number = F.concat(F.translate(F.substring(t, 1, 1), "XYZ", "012"), F.substring(t, 2, 7)).try_cast("int")
    foreigner = F.substring(letters, number % 23 + 1, F.lit(1)) == F.substring(t, 9, 1)
    digit = lambda i: F.substring(t, i, 1).try_cast("int")
    even = digit(3) + digit(5) + digit(7)
    odd = reduce(lambda a, b: a + b, [(2 * digit(i) % 10) + F.floor(2 * digit(i) / 10) for i in (2, 4, 6, 8)])
    check = (10 - (even + odd) % 10) % 10
    last = F.substring(t, 9, 1)
    company = (last == check.cast("string")) | (last == F.substring(F.lit("JABCDEFGHI"), check.cast("int") + 1, F.lit(1)))
    ok = F.when(t.rlike("^[0-9]{8}[A-Z]$"), person).when(t.rlike("^[XYZ][0-9]{7}[A-Z]$"), foreigner).when(t.rlike("^[ABCDEFGHJNPQRSUVW][0-9]{7}[0-9A-J]$"), company)
    return F.coalesce(ok, F.lit(False))


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles and tags go, the common entities are read, blanks are squeezed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)
