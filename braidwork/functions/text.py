"""Text functions as column expressions (N1-N8, N11-N14, F6-F8). Only NFC needs Arrow: Spark has no normalisation function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.config import DANGER_WORDS, FORBIDDEN_WORDS, NEGATIVE_PERSON_WORDS, SAFE_PHRASES, TRACKING_PARAMETERS


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; apply once where data come in."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_name(name: Column) -> Column:
    """N1, for NFC input: without corporate marks, spaces and light punctuation, in lower case."""
    bare = F.regexp_replace(name, r"\(주\)|㈜|\(유\)|주식회사", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\s+", ""), "[.,'\"“”‘’·\\-_/]", ""))


def normalize_entity(name: Column) -> Column:
    """N2, for NFC input: brackets go too, case and corporate suffixes stay."""
    return F.regexp_replace(F.regexp_replace(name, r"\s+", ""), "[.,'\"“”‘’·\\-_/()\\[\\]{}]", "")


def first_syllable_equal(a: Column, b: Column) -> Column:
    """The first code points agree; false if either is empty."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.left(a, F.lit(1)) == F.left(b, F.lit(1)))


#: The Unicode letters from which a Hangul syllable is built; a cluster that sounds as two is written as two (fixed values).
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏ ㅐ ㅑ ㅒ ㅓ ㅔ ㅕ ㅖ ㅗ ㅗㅏ ㅗㅐ ㅚ ㅛ ㅜ ㅜㅓ ㅜㅔ ㅟ ㅠ ㅡ ㅢ ㅣ".split()
TAILS = ["", *"ㄱ ㄲ ㄱㅅ ㄴ ㄴㅈ ㄴㅎ ㄷ ㄹ ㄹㄱ ㄹㅁ ㄹㅂ ㄹㅅ ㄹㅌ ㄹㅍ ㄹㅎ ㅁ ㅂ ㅂㅅ ㅅ ㅆ ㅇ ㅈ ㅊ ㅋ ㅌ ㅍ ㅎ".split()]


def jamo(text: Column) -> Column:
    """Hangul syllables spelled out, other characters as they are."""
    lead, vowel, tail = (F.array(*[F.lit(x) for x in xs]) for xs in (LEADS, VOWELS, TAILS))

    def spell(c: Column) -> Column:
        k = F.ascii(c) - 0xAC00
        parts = F.concat(F.get(lead, (k / 588).cast("int")), F.get(vowel, (k % 588 / 28).cast("int")), F.get(tail, (k % 28).cast("int")))
        return F.when((k >= 0) & (k <= 11171), parts).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), spell), "")


def display_title(title: Column, outlet: Column | None = None) -> Column:
    """N6, for NFC input: half-width, straight quotes, no leading tags, no trailing outlet, single spaces."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　“”‘’"
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " \"\"''"
    t = F.regexp_replace(F.translate(title, full, half), r"^(\s*\[[^\[\]]{1,10}\]\s*)+", "")
    if outlet is not None:
        tail = F.concat(F.lit(r"\s*[-|·]\s*\Q"), outlet, F.lit(r"\E\s*$"))
        t = F.when(outlet.isNotNull() & (outlet != ""), F.regexp_replace(t, tail, F.lit(""))).otherwise(t)
    return squash(t)


def title_tokens(title: Column) -> Column:
    """Overlapping pairs of letters and digits, repeats included; a single one stands alone."""
    c = F.regexp_replace(title, r"[^\p{L}\p{N}]", "")
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) == 1, F.array(c)).otherwise(grams)


def strip_tags(html: Column) -> Column:
    return squash(F.regexp_replace(html, "<[^>]*>", " "))


def lead_text(description: Column, most: int = 200) -> Column:
    """The first characters of a description without tags; null if nothing is left."""
    t = F.substring(strip_tags(description), 1, most)
    return F.when(t != "", t)


def _escaped_path(path: Column) -> Column:
    """Characters that a path can't hold as they are become escapes of their UTF-8 bytes; what is escaped already stays."""
    odd = r'[\x00-\x20"#<>?`{}\x7F-\x{10FFFF}]'
    escape = lambda c: F.when(c.rlike(odd), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1")).otherwise(c)
    return F.when(path.rlike(odd), F.array_join(F.transform(F.split(path, ""), escape), "")).otherwise(path)


def _form_decoded(part: Column) -> Column:
    """A name or value of a query: + is a space, escapes are bytes of UTF-8, a % that begins none is itself."""
    return F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def canonical_url(url: Column) -> Column:
    """Tracking parameters out, others sorted by name (equal names keep their order), lower-case host without the scheme's
    usual port, no fragment, no trailing slash. Names and values are decoded, and written again with the escapes of a form;
    a path's characters are escaped where they have to be. Anything that isn't an absolute URL is only trimmed. Host names
    stay in their own script, and dots in paths are not resolved."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)), F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    usual = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    named = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p, i: F.struct(_form_decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), F.when(p.contains("="), _form_decoded(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)))).otherwise(F.lit("")).alias("v")))
    sorted_ = F.array_sort(F.filter(named, lambda x: ~x["k"].isin(*TRACKING_PARAMETERS)))
    kept = F.array_join(F.transform(sorted_, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.when((scheme == "") | (host == ""), u).otherwise(F.concat(scheme, F.lit("://"), usual, _escaped_path(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def input_hash(*parts: Column) -> Column:
    """SHA-256 in hex of the parts joined by NUL; a null part counts as empty."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\0"), 256)


def forbidden_words(text: Column) -> Column:
    """array of (word, index) of all occurrences outside safe phrases, words in their order; null text gives none."""
    return F.concat(*[_occurrences(_masked(text), w) for w in FORBIDDEN_WORDS])


def has_forbidden_words(text: Column) -> Column:
    """whether there is any, in one scan."""
    return mentions_any(_masked(text), FORBIDDEN_WORDS)


def _masked(text: Column) -> Column:
    masked = F.coalesce(text, F.lit(""))
    for p in SAFE_PHRASES:
        masked = F.replace(masked, F.lit(p), F.lit(" " * len(p)))
    return masked


def _occurrences(text: Column, word: str) -> Column:
    """The k-th occurrence begins after k + 1 of the pieces between occurrences, and k words."""
    pieces = F.split(text, re.escape(word))
    before = lambda k: F.aggregate(F.slice(pieces, 1, k + 1), F.lit(0), lambda a, x: a + F.length(x)) + k * len(word)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, k: F.struct(F.lit(word).alias("word"), before(k).cast("int").alias("index")))


def mentions_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("|".join(map(re.escape, words))), F.lit(False))


def is_dangerous(headline: Column) -> Column:
    return mentions_any(headline, DANGER_WORDS)


def is_negative_person(headline: Column) -> Column:
    return mentions_any(headline, NEGATIVE_PERSON_WORDS)


def long_quotes(summary: Column, sources: Column, most: int = 20) -> Column:
    """F8: different runs of most + 1 characters of the summary that some source text (array) contains."""
    n = most + 1
    windows = F.when(F.length(summary) >= n, F.transform(F.sequence(F.lit(1), F.length(summary) - most), lambda i: F.substring(summary, i, F.lit(n))))
    return F.array_distinct(F.filter(F.coalesce(windows, F.array().cast("array<string>")), lambda w: F.exists(sources, lambda s: F.contains(s, w))))


def path_text(labels: Column) -> Column:
    return F.array_join(labels, " → ")


def chip_tone(business: Column, is_meme: Column) -> Column:
    """P10."""
    return F.when(is_meme, "gray").when(business >= 60, "green").when(business >= 30, "blue").otherwise("gray")
