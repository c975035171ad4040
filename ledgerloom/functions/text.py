"""Cell and narrative parsing as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that mean "no amount", which is not the same as an amount of zero (fixed values).
BLANK_CELLS = ("", "-", "--", "NIL", "nil", "N/A")
# Marks around an amount (fixed values).
CURRENCY_PREFIX = r"(?i)^(inr|rs\.?|usd|eur|₹|\$|€)\s*"
TRAILING_MARK = r"(?i)\b(cr|dr)\.?$"
BRACKETED = r"^\((.*)\)$"
# Cells that are a number as they stand, and all that can be one once marks and separators are off (fixed values).
PLAIN_NUMBER = r"^-?\d+(\.\d+)?\z"
MAYBE_NUMBER = r"(?i)^(?:inr|rs\.?|usd|eur|₹|\$|€)?[\s,(+\-]*+\d[\d.,\s)crd\x85\u2028\u2029]*+\z"

# Rail and document words that are never part of a counterparty name (fixed values).
RAIL_WORDS = (
    "NEFT", "IMPS", "RTGS", "UPI", "ACH", "CHQ", "DEP", "CR", "DR", "REF", "TXN", "BATCH", "PAYMENT", "BILL", "CHALLAN", "DEBIT", "CREDIT",
    "AC", "LOAN", "EMI", "SALARY", "GST", "RENT", "ELECTRICITY", "UTILITIES",
)

# Date layouts in order of preference: name, Spark pattern, shape of the cell (fixed values).
DATE_FORMATS = (
    ("year-month-day", "y-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("year/month/day", "y/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("day-mon-year", "d-MMM-y", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("day mon year", "d MMM y", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("day-monthname-year", "d-MMMM-y", r"^\d{1,2}-[A-Za-z]+-\d{4}$"),
    ("day/month/year", "d/M/y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("month/day/year", "M/d/y", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("day-month-year", "d-M-y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("month-day-year", "M-d-y", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("day/month/yy", "d/M/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("month/day/yy", "M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
)
AMBIGUOUS = {"day/month/year": "month/day/year", "day-month-year": "month-day-year", "day/month/yy": "month/day/yy"}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named, and no code generated for either."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marked_amount(s: Column) -> Column:
    """Value of a trimmed cell once its brackets, currency, trailing mark and commas are off."""
    def signed(bare: Column, body: Column, inner: Column) -> Column:
        minus = bare.startswith("-")
        digits = F.regexp_replace(F.regexp_replace(bare, "^-", ""), r"^\+", "")
        debit_mark = F.lower(F.regexp_extract(inner, TRAILING_MARK, 1)) == "dr"
        flips = body.rlike(BRACKETED).cast("int") + debit_mark.cast("int") + minus.cast("int")
        value = bound(digits, lambda d: F.when(d.rlike(r"^-?\d+(\.\d+)?$"), d.try_cast("decimal(28,2)")))
        return bound(value, lambda v: F.when(flips % 2 == 1, -v).otherwise(v))

    def unmarked(inner: Column, body: Column) -> Column:
        return bound(F.translate(F.trim(F.regexp_replace(inner, TRAILING_MARK, "")), ", ", ""), lambda bare: signed(bare, body, inner))

    unbracketed = lambda b: F.when(b.rlike(BRACKETED), F.trim(F.regexp_extract(b, BRACKETED, 1))).otherwise(b)
    return bound(F.trim(F.regexp_replace(s, CURRENCY_PREFIX, "")), lambda body: bound(unbracketed(body), lambda inner: unmarked(inner, body)))


def parse_amount(cell: Column) -> Column:
    """Currency cell -> decimal(28,2); NULL for blank or not a number.

    Parentheses and a trailing Dr negate; a currency prefix, a trailing Cr and any
    grouping commas are dropped.  The marks are looked for only where a number can remain: each of
    their patterns costs as much as the test, and most cells are texts, dates or plain numbers.
    """
    s = F.trim(F.coalesce(cell, F.lit("")))
    marked = F.when(~s.isin(*BLANK_CELLS) & s.rlike(MAYBE_NUMBER), _marked_amount(s))
    return F.when(s.rlike(PLAIN_NUMBER), s.try_cast("decimal(28,2)")).otherwise(marked).cast("decimal(28,2)")


def may_be_date(cell: Column) -> Column:
    """False for cells that no layout can read."""
    return F.trim(cell).rlike(r"^\d{1,4}[-/ ][A-Za-z0-9]+[-/ ]\d{1,4}$")


def parse_date(cell: Column, pattern: str, shape: str) -> Column:
    """Date under one layout, NULL on failure; two-digit years below 69 are 20xx."""
    s = F.trim(cell)
    d = F.when(s.rlike(shape), F.try_to_date(s, pattern))
    if pattern.endswith("yy") and not pattern.endswith("yyyy"):
        d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_date_named(cell: Column, name: Column) -> Column:
    """Date under the layout named in another column."""
    out = F.lit(None).cast("date")
    for n, pattern, shape in DATE_FORMATS:
        out = F.when(name == n, parse_date(cell, pattern, shape)).otherwise(out)
    return out


def counterparty_name(narrative: Column) -> Column:
    """Proper name from the words of a narrative: words with a digit go, and so do rail words, also inside hyphens."""
    words = F.split(F.coalesce(narrative, F.lit("")), r"[\s/\\|]+")
    kept = F.filter(words, lambda w: ~w.rlike("[0-9]"))
    bare = F.transform(kept, lambda w: F.array_join(F.transform(F.split(w, r"\b"), lambda p: F.when(F.upper(p).isin(*RAIL_WORDS), " ").otherwise(p)), ""))
    # A capital after anything that is not a letter, so after hyphens and apostrophes as well.
    runs = lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    proper = lambda s: F.when(F.length(s) >= 3, F.array_join(F.transform(runs(s), F.initcap), "")).otherwise("UNKNOWN")
    return bound(F.btrim(F.regexp_replace(F.array_join(bare, " "), r"\s+", " "), F.lit(" -_.")), proper)


def name_uuid(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID text of ``name`` in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), 1, 1)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

# Glyphs that character recognition confuses with digits (fixed values).
GLYPHS_FROM, GLYPHS_TO = "OoDQlI|SsBZz", "000011155822"


# Separators inside a run of digits (fixed values).
SEPARATORS = "., \t\n\x0b\f\r"


def _run_value(run: Column) -> Column:
    """Value of a run of digits, which starts and ends with one."""
    digits = F.translate(run, SEPARATORS, "")

    def dotted(last: Column) -> Column:
        plain = lambda c: F.translate(c, SEPARATORS, "")
        return F.concat(plain(F.left(run, F.length(run) - F.length(last) - 1)), F.lit("."), plain(last))

    def grouped(groups: Column) -> Column:
        n = F.size(groups)
        middle = F.slice(groups, 2, F.greatest(F.lit(0), n - 2))
        split_fraction = (
            (n > 1) & (F.length(F.element_at(groups, -1)) == 2) & (F.length(groups[0]) <= 3) & F.forall(middle, lambda g: F.length(g) == 3)
        )
        return F.when(split_fraction, F.concat(F.array_join(F.slice(groups, 1, n - 1), ""), F.lit("."), F.element_at(groups, -1))).otherwise(digits)

    marks = F.length(run) - F.length(digits)
    text = (
        F.when((marks == 0) | ((marks == 1) & run.contains(".")), run)
        .when(run.contains("."), bound(F.substring_index(run, ".", -1), dotted)).otherwise(bound(F.split(run, r"[,\s]+"), grouped))
    )
    return text.try_cast("decimal(20,2)")


def digit_runs(line: Column) -> Column:
    """Runs of three digits or more in a recognized line, as read and with glyphs repaired; mostly the same ones.

    Repairing adds digits alone, so a line without a run in the repaired reading has none.
    """
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"(\d[.,\s]*\d[\d.,\s]*\d)"), 1)
    repaired = F.translate(line, GLYPHS_FROM, GLYPHS_TO)
    return F.when(repaired.rlike(r"\d[.,\s]*\d[.,\s]*\d"), F.array_union(runs(line), runs(repaired)))


def amount_of_runs(runs: Column) -> Column:
    """Value of the longest run above zero; a line mostly has one, for which nothing is compared, and which may give zero."""
    scored = F.transform(runs, lambda r: F.struct(F.length(F.translate(r, SEPARATORS, "")).alias("digits"), _run_value(r).alias("value")))
    return F.when(F.size(runs) == 1, _run_value(F.get(runs, F.lit(0)))).otherwise(F.array_max(F.filter(scored, lambda s: s["value"] > 0))["value"])


def noisy_amount(line: Column) -> Column:
    """Amount in a recognized line: longest digit run, as read or with glyphs repaired."""
    return bound(bound(digit_runs(line), amount_of_runs), lambda v: F.when(v > 0, v))


def noisy_date(line: Column) -> Column:
    """dd?mm?yyyy with any separator, run together, or ISO; NULL when none is a date."""
    t = F.replace(line, F.lit(" "), F.lit(""))
    part = lambda p, order: F.try_to_date(
        F.concat_ws("/", *[F.regexp_extract(t, p, i) for i in order]), "yyyy/MM/dd"
    )
    dmy, run, iso = r"(\d{2})[^\d](\d{2})[^\d](\d{4})", r"(\d{2})(\d{2})(\d{4})", r"(\d{4})[^\d](\d{2})[^\d](\d{2})"
    return F.coalesce(*[F.when(t.rlike(p), part(p, o)) for p, o in ((dmy, (3, 2, 1)), (run, (3, 2, 1)), (iso, (1, 2, 3)))])


# Patterns of numbers on documents (fixed values).
INVOICE_PATTERN = r"(?i)[I1l|]NV[\s\-–_]?(\d{3,4})[\s\-–_]?(\d{2})(?!\d)"
REGISTRATION_PATTERN = r"(?i)\d{2}[A-Z]{5}\d{4}[A-Z]"


def invoice_number(text: Column) -> Column:
    """INV-nnnn-nn, read as is or with glyphs repaired."""
    def read(t: Column) -> Column:
        return F.when(t.rlike(INVOICE_PATTERN), F.concat_ws("-", F.lit("INV"), F.regexp_extract(t, INVOICE_PATTERN, 1), F.regexp_extract(t, INVOICE_PATTERN, 2)))

    # Repairing glyphs makes digits alone, so both readings need the letters.
    return F.when(F.lower(text).contains("nv"), F.coalesce(read(text), read(F.translate(text, GLYPHS_FROM, GLYPHS_TO))))


def is_registration_number(text: Column) -> Column:
    return text.rlike(REGISTRATION_PATTERN)
