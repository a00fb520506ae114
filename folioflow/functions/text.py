"""Text scalars as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4e00}-\x{9fff}]"
_EDGE = r"[\s·•\-–—:：]+"
_QUOTE = "['\"“”‘’]"


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def count(c: Column, pattern: str) -> Column:
    """How many characters of a class a text has: what its removal takes away, without a list of matches."""
    return F.length(_empty(c)) - F.length(F.regexp_replace(_empty(c), pattern, ""))


def norm_text(c: Column) -> Column:
    """Lower case; everything but a-z, 0-9, apostrophes turned blank and Han characters becomes one space."""
    plain = F.regexp_replace(F.lower(_empty(c)), "[‘’“”]", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}]", " "), " +", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the normalised texts."""
    return _alike(norm_text(a), norm_text(b))


def _alike(x: Column, y: Column) -> Column:
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / most)


def same_text(a: Column, b: Column, threshold: float = 0.82) -> Column:
    return same_norm(norm_text(a), norm_text(b), threshold)


def same_norm(x: Column, y: Column, threshold: float = 0.82) -> Column:
    """``same_text`` of texts that are normalised already: a fold over many pairs normalises each text once."""
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = F.contains(x, y) | F.contains(y, x)
    return (short > 0) & ((x == y) | (inside & (short / long >= 0.6)) | (_alike(x, y) >= threshold))


def split_lines(c: Column) -> Column:
    return F.split(F.regexp_replace(_empty(c), "\r\n?", "\n"), "\n")


def clean_text(c: Column) -> Column:
    """White space collapsed; bullets, colons and wrapping quotes stripped. A quote after a digit (inches) stays."""
    s = F.regexp_replace(F.regexp_replace(_empty(c), "[\u00a0\r\n\t]", " "), " {2,}", " ")
    s = F.regexp_replace(s, "^" + _EDGE, "")
    s = F.regexp_replace(s, f"^{_QUOTE}(?=[A-Za-z0-9\\x{{4e00}}-\\x{{9fff}}])", "")
    s = F.regexp_replace(s, _EDGE + "$", "")
    return F.trim(F.regexp_replace(s, f"(?<=[^0-9]){_QUOTE}$", ""))


#: Glyph names that exporters leave for ligatures, and their letters.
LIGATURES = (("/f_", "f"), ("/_/", ""), ("/ffl", "ffl"), ("/ff", "ff"), ("/fi", "fi"), ("/fl", "fl"), ("\ufffd", ""))


def clean_pdf_text(c: Column) -> Column:
    """Glyph names that exporters leave for ligatures become letters; longer names first."""
    s = _empty(c)
    for name, letters in LIGATURES:
        s = F.replace(s, F.lit(name), F.lit(letters))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def cleanup_punct(c: Column) -> Column:
    s = F.regexp_replace(_empty(c), r"\s+([，。；：！？、）】」』])", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"([（【「『])\s+", "$1"), "[ \t]{2,}", " "))


def join_src(a: Column, b: Column) -> Column:
    x, y = F.trim(_empty(a)), F.trim(_empty(b))
    return F.when(x == "", y).when(y == "", x).otherwise(F.concat(x, F.lit(" "), y))


def join_dst(a: Column, b: Column) -> Column:
    """No space where either side is blank or East Asian at the seam."""
    x, y = _empty(a), _empty(b)
    cjk = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}\s]"
    tight = (x == "") | (y == "") | x.rlike(cjk + "$") | y.rlike("^" + cjk)
    return F.when(tight, F.concat(x, y)).otherwise(F.concat(x, F.lit(" "), y))


def is_mostly_han(c: Column) -> Column:
    return count(c, HAN) > count(c, "[A-Za-z]")


def looks_readable(c: Column) -> Column:
    return _empty(c).rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]")


def looks_like_noise(text: Column, conf: Column) -> Column:
    """Recognition rubbish: too short, unsure, letterless, one repeated sign, mostly symbols, or vowelless."""
    s = F.trim(_empty(text))
    bare, letters = F.regexp_replace(s, r"\s", ""), F.regexp_replace(s, "[^A-Za-z]", "")
    return (
        (F.length(s) < 2) | F.coalesce(conf < 35, F.lit(False)) | ~s.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]") | bare.rlike(r"^(.)\1+$")
        | (count(s, r"[^A-Za-z0-9\x{4e00}-\x{9fff}\s]") > F.length(s) * 0.5) | ((F.length(letters) >= 5) & ~letters.rlike("[aeiouAEIOU]"))
    )


#: Patterns of code-like fields.
CODE_FIELDS = (r"(?i)^(PMS|SKU|ITEM|ART|MODEL)\b", r"(?i)^[\d\s.,%'\"/x×\-+]+$", r"(?i)^[\d.,]+\s*(in|inch|cm|mm|m|ft|kg|g|oz|lb|pcs?|%)$")


def classify_field(c: Column) -> Column:
    s = F.trim(_empty(c))
    length = count(s, "[A-Za-z]") + count(s, HAN)
    code = s.rlike(CODE_FIELDS[0]) | s.rlike(CODE_FIELDS[1]) | s.rlike(CODE_FIELDS[2])
    return (
        F.when(s == "", "normal").when(code, "code").when((length >= 22) | s.rlike("[.。;；]"), "note")
        .when(s.rlike(r"^[A-Z0-9\s/&.\-]{2,}$"), "label").when(length <= 14, "label").otherwise("normal")
    )


#: What must survive translation unchanged.
CODES = "|".join((
    r"\bPMS\s+(?:[0-9]{2,4}(?:\s*[A-Z]{1,3})?|[A-Za-z]+(?:\s+[A-Za-z]+)*\s+C)\b",
    r"\d+\s*['\x{2019}\x{2032}]\s*\d+\s*[\"\x{201d}\x{2033}]",
    r"\d+(?:\.\d+)?\s*(?:cm|mm|km|inch|inches|ft|feet|yd|kg|kgs|mg|lb|lbs|oz|ml|pcs|pc|set|sets)\b",
    r"\d+(?:\.\d+)?\s*%",
    r"\b[A-Z0-9]{2,}(?:-[A-Z0-9]+)+\b",
    r"\b\d{2,}\b",
))
OPEN, CLOSE = "", ""


def codes(c: Column) -> Column:
    return F.regexp_extract_all(_empty(c), F.lit(CODES), F.lit(0))


#: No code without a digit, a colour name or a hyphenated id: a cheap test before the patterns.
MAY_HOLD_CODES = "[0-9]|PMS|[A-Z0-9]-[A-Z0-9]"


def protected(c: Column) -> Column:
    """``codes`` and ``masked`` of a text in one struct; texts without a sign of any code are not searched."""
    may = _empty(c).rlike(MAY_HOLD_CODES)
    found = F.when(may, codes(c)).otherwise(F.array().cast("array<string>"))
    return F.struct(found.alias("codes"), F.when(may, mask_codes(c)).otherwise(_empty(c)).alias("masked"))


def mask_codes(c: Column, known: Column | None = None) -> Column:
    """Codes replaced by numbered placeholders; gaps and numbers are woven together again without a UDF.

    ``known``, if given, are the text's codes, so that they need not be found again.
    """
    gaps = F.split(_empty(c), CODES, -1)
    last = F.size(gaps) - 1 if known is None else F.size(known)
    marks = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i < last, F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(F.lit("")))
    return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")


def ascii_digits(c: Column) -> Column:
    return F.translate(_empty(c), "０１２３４５６７８９", "0123456789")


def restore_codes(masked: Column, known: Column) -> Column:
    """Placeholders (blanks and full-width digits inside are fine) back to codes; numbers out of range stay as they are."""
    pattern = f"{OPEN}\\s*[0-9０-９]+\\s*{CLOSE}"
    found, gaps = F.regexp_extract_all(_empty(masked), F.lit(pattern), F.lit(0)), F.split(_empty(masked), pattern, -1)

    def put(m: Column) -> Column:
        i = F.regexp_replace(ascii_digits(m), "[^0-9]", "").cast("int")
        return F.when(i < F.size(known), F.get(known, i)).otherwise(m)

    filled = F.concat(F.transform(found, put), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, filled, lambda g, m: F.concat(g, m)), "")


def lost_codes(restored: Column, known: Column) -> Column:
    return F.filter(known, lambda k: F.instr(restored, k) == 0)


def residue(restored: Column, known: Column) -> Column:
    """What is wrong with a restored text: placeholders or halves of them left in it, codes lost; empty if nothing."""
    lost = lost_codes(restored, known)
    left = F.when(_empty(restored).rlike(f"[{OPEN}{CLOSE}]"), "placeholder left")
    return F.concat_ws("; ", left, F.when(F.size(lost) > 0, F.concat(F.lit("lost: "), F.array_join(lost, ", "))))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, in base 36: a code point above the basic plane counts as its two surrogates.

    A step hangs on the one before, so texts of a batch are hashed side by side, unit by unit.
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([np.base_repr(h, 36).lower() for h in fnv1a_all(s.tolist())], dtype=object)

    return run(_empty(c))


def fnv1a_all(texts: list[str], few: int = 16) -> list[int]:
    """FNV-1a of each text; the last ``few`` that go on, the longest, are finished one by one."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 2 for r in raw], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order] if len(raw) else lengths
    units, ends = np.frombuffer(b"".join(raw), dtype="<u2").astype(np.uint32), -lengths[order]
    h, prime, at = np.full(len(raw), 2166136261, dtype=np.uint32), np.uint32(16777619), 0
    while (n := int(np.searchsorted(ends, -at, side="left"))) > few:  # the first n are longer than ``at``
        h[:n] = (h[:n] ^ units[starts[:n] + at]) * prime
        at += 1
    for i in range(n):
        left = int(h[i])
        for unit in units[starts[i] + at : starts[i] - ends[i]].tolist():
            left = ((left ^ unit) * 16777619) & 0xFFFFFFFF
        h[i] = left
    out = np.empty(len(raw), dtype=np.int64)
    out[order] = h
    return out.tolist()


#: Names of target languages.
LANGUAGES = {"zh-CN": "Simplified Chinese", "zh-TW": "Traditional Chinese"}


def lang_name(c: Column) -> Column:
    out = F.lit(LANGUAGES["zh-CN"])
    for code, name in LANGUAGES.items():
        out = F.when(c == code, name).otherwise(out)
    return out


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.format_number(ms / 1000, 1), F.lit(" s")))


def output_stem(name: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(suffix))


def file_kind(name: Column, mime: Column) -> Column:
    pdf = name.rlike(r"(?i)\.pdf$") | (mime == "application/pdf")
    image = name.rlike(r"(?i)\.(png|jpe?g|webp|bmp|gif)$") | mime.startswith("image/")
    return F.when(F.coalesce(pdf, F.lit(False)), "pdf").when(F.coalesce(image, F.lit(False)), "image")


def strip_fences(c: Column) -> Column:
    s = F.regexp_replace(_empty(c), r"^\s+|\s+$", "")
    inner = F.regexp_extract(s, r"(?s)```[a-zA-Z0-9_-]*\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(s)


#: Words of other languages in would-be JSON, and what they stand for.
FOREIGN_LITERALS = (("None", "null"), ("True", "true"), ("False", "false"), ("NaN", "null"), ("Infinity", "null"))


def repair_json(c: Column) -> Column:
    """Trailing commas go first, then foreign literals, then bare keys get quotes."""
    s = F.regexp_replace(_empty(c), r",\s*([}\]])", "$1")
    for word, json in FOREIGN_LITERALS:
        s = F.regexp_replace(s, rf"\b{word}\b", json)
    key = r"([A-Za-z_$\x{4e00}-\x{9fff}][A-Za-z0-9_$\x{4e00}-\x{9fff}]*)(\s*:)"
    return F.regexp_replace(F.regexp_replace(s, r"([{,]\s*)" + key, '$1"$2"$3'), r"(\[\s*)" + key, '$1"$2"$3')


def chat_endpoint(url: Column) -> Column:
    u = F.regexp_replace(F.trim(_empty(url)), "/+$", "")
    deepseek = u.rlike(r"(?i)^https?://api\.deepseek\.com$")
    return F.when(u.rlike("/chat/completions$"), u).when(deepseek | u.rlike(r"/v[0-9]+[a-z0-9]*$"), F.concat(u, F.lit("/chat/completions"))).otherwise(F.concat(u, F.lit("/v1/chat/completions")))


def retryable(status: Column) -> Column:
    return (status == 408) | (status == 429) | status.between(500, 599)


def models_endpoint(url: Column) -> Column:
    """Where a service lists its models; follows the rules of ``chat_endpoint``."""
    u = F.regexp_replace(F.trim(_empty(url)), "/+$", "")
    base = F.regexp_replace(u, "(?i)/chat/completions$", "")
    deepseek = base.rlike(r"(?i)^https?://api\.deepseek\.com$")
    return F.when(u.rlike("(?i)/models$"), u).when(deepseek | base.rlike(r"/v[0-9]+[a-z0-9]*$"), F.concat(base, F.lit("/models"))).otherwise(F.concat(base, F.lit("/v1/models")))


def cache_key(raw: Column, lang: Column, engine: Column, model: Column, glossary: Column, preserve: Column) -> Column:
    """What a remembered translation hangs on; ``glossary`` is a fingerprint, and the model counts for model engines alone."""
    return F.concat_ws("\x01", lang, engine, F.when(engine == "llm", _empty(model)).otherwise(""), glossary, F.when(preserve, "1").otherwise("0"), _empty(raw))


def backoff_ms(attempt: Column, retry_after_s: Column) -> Column:
    """Wait before another attempt: as the service asks, else doubling from half a second, ten seconds at most."""
    asked = F.when(retry_after_s > 0, retry_after_s * 1000)
    return F.least(F.lit(10000.0), F.coalesce(asked, 500 * F.pow(F.lit(2.0), attempt)))
