"""Text and number expressions that the views share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import SLANG

WORD = "[A-Za-z][A-Za-z'’]*[A-Za-z]|[A-Za-z]"
# What chat exports write in place of a file or of a deleted message.
MEDIA = ("<media omitted>", "image omitted", "video omitted", "audio omitted", "sticker omitted", "gif omitted", "document omitted", "this message was deleted", "you deleted this message", "<attached:")
# A part of each of them, which must stand in a text in pure lower or pure upper case.
MEDIA_HINTS = ("mitted", "elete", "ttach")
# Stretched and laughing parts of words.
STRETCHED = ("ooo", "aaa", "eee", "yyy", "mmm", "zz", "haha", "hehe", "lol")
_MODIFIED = "[\U0001f300-\U0001faff☀-➿⬅-⭕][\U0001f3fb-\U0001f3ff️]*"
EMOJI = f"[\U0001f1e6-\U0001f1ff]{{2}}|{_MODIFIED}(?:‍{_MODIFIED})*"


def words_of(text: Column) -> Column:
    """The words of a message: links, mentions and tags hold none."""
    return latin_words(sanitise(text))


def latin_words(text: Column) -> Column:
    """Latin words of clean text; both apostrophes count as one, digits and accents split."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.replace(x, F.lit("’"), F.lit("'")))


def is_media(text: Column) -> Column:
    """A placeholder in pure lower case, pure upper case or as exported; mixed spellings of its hint don't count."""
    return text.rlike("|".join(h for x in MEDIA_HINTS for h in (x, x.upper()))) & F.lower(text).rlike("|".join(MEDIA))


def emoji_of(text: Column) -> Column:
    # possessive: the matcher would recurse into the group of a long chain
    return F.regexp_extract_all(text, F.lit(f"{EMOJI}+"), F.lit(0))


def sanitise(text: Column) -> Column:
    """Links, mentions and tags become spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"https?://\S+", " "), r"www\.\S+", " "), r"(?U)[@#]\w+", " ")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def shouted(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def noise(word: Column) -> Column:
    """Too short, slang, one letter repeated, stretched or laughing, or not letters."""
    return (F.length(word) < 3) | word.isin(SLANG) | word.rlike(r"^(.)\1{2,}$|" + "|".join(STRETCHED)) | ~word.rlike("^[a-z']+$")


def ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """num / den, rounded half to even from integers; 0 where den is 0."""
    num, den = ((F.col(x) if isinstance(x, str) else x).cast("decimal(30,0)") for x in (num, den))
    scaled, both = 2 * num * 10**digits + den, F.nullif(2 * den, F.lit(0).cast("decimal(30,0)"))
    up = F.floor(scaled / both)
    even = up - F.when((scaled % both == 0) & (up % 2 == 1), 1).otherwise(0)
    return F.coalesce(even.cast("double") / 10**digits, F.lit(0.0))


def whole_word(text: Column, word: str) -> Column:
    """word stands alone, whatever its case and apostrophe."""
    import re

    own = "['’]".join(re.escape(part) for part in re.split("['’]", word))
    return text.rlike(rf"(?iu)(?<![A-Za-z'’]){own}(?![A-Za-z'’])")


def minutes_label(minutes: Column) -> Column:
    """Under an hour in minutes, under a day in hours, else in days."""
    return F.when(minutes.isNull(), "–").when(minutes < 60, F.concat(F.round(minutes).cast("long").cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.format_number(minutes / 60, 1), F.lit(" h"))).otherwise(F.concat(F.format_number(minutes / 1440, 1), F.lit(" d")))


def compact_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_number(n / 1e6, 1), F.lit("M"))).when(n >= 10_000, F.concat(F.round(n / 1000).cast("long").cast("string"), F.lit("K"))).otherwise(n.cast("string"))
