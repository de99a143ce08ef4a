"""Text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space at the ends of a probe key, skip patterns and part-of-speech marks.
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
SKIP_PATTERNS = (
    r"(?U)^[\d\s,.%$€¥£₹+\-]+$",
    r"(?U)^\d{4}[-/]\d{1,2}[-/]\d{1,2}$",
    r"(?U)^\d{1,2}:\d{2}(:\d{2})?$",
    r"(?U)^[\w.+-]+@[\w-]+\.[\w.]+$",
    r"(?i)^https?://",
    r"(?iU)^v?\d+\.\d+",
)
#: The scripts and codes of Chinese, names of languages.
CJK = r"[\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af]"
POS = r"(?i)^(n|v|vt|vi|adj|adv|prep|conj|pron|art|abbr|num|aux)\."
CHINESE = ("zh", "zh-hans", "zh-cn", "zh-hant", "zh-tw", "zh-hk")
LANGUAGE_NAMES = {
    "zh": "Simplified Chinese", "zh-hans": "Simplified Chinese", "zh-cn": "Simplified Chinese",
    "zh-hant": "Traditional Chinese", "zh-tw": "Traditional Chinese", "zh-hk": "Traditional Chinese (Hong Kong)",
    "en": "English", "fr": "French", "es": "Spanish", "ru": "Russian", "ar": "Arabic", "ja": "Japanese", "ko": "Korean",
}
#: Ordered classes of error messages with the substrings that tell them.
ERROR_CLASSES = (
    ("rate_limit", ("rate limit", "429", "too many requests")),
    ("timeout", ("timeout", "timed out")),
    ("connection", ("connect",)),
    ("credentials", ("401", "unauthorized", "api key", "apikey")),
    ("rejected", ("400", "bad request")),
    ("ocr", ("ocr", "paddle")),
    ("storage", ("minio", "s3")),
)


def norm_sql(c: Column) -> Column:
    """Stored key: lower case, spaces trimmed."""
    return F.lower(F.trim(c))


def norm_text(c: Column) -> Column:
    """Probe key: lower case, all Unicode white space stripped."""
    return F.lower(strip(c))


def strip(c: Column) -> Column:
    """Unicode white space stripped; texts that begin and end in a visible ASCII character, most ones, need no pattern."""
    bare = F.ascii(F.left(c, F.lit(1))).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(bare, c).otherwise(F.regexp_replace(c, EDGE, ""))


def distinct_words(c: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each in lower case with two spaces before it and one behind."""
    padded = F.transform(distinct_words(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def sheet_title(title: Column, original: Column, most: int = 31) -> Column:
    """A sheet's title without characters that sheets can't have, quotes at its ends and what is beyond ``most`` characters; the
    original if nothing is left or the name is reserved."""
    bare = F.regexp_replace(strip(title), r"[\\\\/*?:\[\]]", "_")
    bare = strip(F.left(F.regexp_replace(bare, "^'+|'+$", ""), F.lit(most)))
    return F.when((bare == "") | (F.lower(bare) == "history"), original).otherwise(bare)


def bigram_codes(c: Column) -> Column:
    """Distinct character bigrams as numbers, the two code points of each; numbers are compared far faster than strings."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("bigint"))
    n = F.greatest(F.length(c) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * (1 << 21) + b))


def bigrams(c: Column) -> Column:
    """Distinct character bigrams."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?s)(?=(..))"), F.lit(1)))


def dice(a: Column, b: Column, ga: Column | None = None, gb: Column | None = None) -> Column:
    """Dice coefficient of bigram sets: 0 if one is empty, 1 if equal or both without bigrams."""
    ga, gb = (bigrams(a) if ga is None else ga), (bigrams(b) if gb is None else gb)
    both, size = F.size(F.array_intersect(ga, gb)), F.size(ga) + F.size(gb)
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
        .when(a == b, 1.0)
        .when(size == 0, 1.0)
        .when((F.size(ga) == 0) | (F.size(gb) == 0), 0.0)
        .otherwise(2.0 * both / size)
    )


def should_skip(c: Column, short_symbols: bool = False) -> Column:
    """Whether a segment has nothing to translate: blank, number, date, time, mail address, URL or version."""
    s = strip(c)
    skip = c.isNull() | (s == "")
    for p in SKIP_PATTERNS:
        skip = skip | s.rlike(p)
    if short_symbols:
        skip = skip | ((F.length(s) <= 2) & ~s.rlike(CJK))
    return F.coalesce(skip, F.lit(True))


def halfwidth_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def clean_term(c: Column) -> Column:
    """First sense and first variant of a dictionary term, without part-of-speech marks, digits folded."""
    first = strip(F.substring_index(strip(c), ";", 1))
    first = strip(F.regexp_replace(first, POS, ""))
    first = strip(F.substring_index(first, ",", 1))
    return halfwidth_digits(strip(F.regexp_replace(first, POS, "")))


def csv_safe(c: Column) -> Column:
    """A cell that spreadsheets do not read as a formula, whatever white space it begins with; null is empty."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(strip(v).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), v)).otherwise(v)


def is_number(c: Column) -> Column:
    s = strip(F.regexp_replace(c, ",", ""))
    return F.coalesce(s.rlike(r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+)(e[+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"), F.lit(False))


def language_pair_code(c: Column) -> Column:
    """Base code of a language tag; the named forms of Chinese are zh."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(s.isin(*CHINESE), "zh").otherwise(F.substring_index(s, "-", 1))


def language_name(c: Column) -> Column:
    own = strip(F.coalesce(c, F.lit("")))
    names = F.create_map(*(F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv))
    return F.when(own == "", "English").otherwise(F.coalesce(F.try_element_at(names, F.lower(own)), F.try_element_at(names, F.substring_index(F.lower(own), "-", 1)), own))


def bilingual(original: Column, translated: Column) -> Column:
    return F.when(norm_text(original) == "", original).otherwise(F.concat_ws("\n", original, translated))


def html_cells(c: Column, tag: str = "td") -> Column:
    """Text of a table's cells, tags stripped, blanks dropped, joined by ' | '."""
    cells = F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.array_join(F.filter(F.transform(cells, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != ""), " | ")


def token_budget(c: Column) -> Column:
    half = F.floor(F.length(c) / 2)
    return F.least(F.lit(8192), F.greatest(F.lit(2048), F.greatest(F.lit(256), half) * 3)).cast("bigint")


def backoff(kind: str, n: Column) -> Column:
    return {"limited": F.least(5 * F.pow(F.lit(2), n), F.lit(60)), "error": F.least(1 + 2 * n, F.lit(60)), "empty": F.least(1 + 2 * n, F.lit(30))}[kind].cast("bigint")


def file_ext(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^.]+)$", 1))


def error_class(c: Column) -> Column:
    m = F.lower(c)
    out = F.lit("other")
    for name, marks in reversed(ERROR_CLASSES):
        said = F.lit(False)
        for x in marks:
            said = said | m.contains(x)
        out = F.when(said, name).otherwise(out)
    return out
