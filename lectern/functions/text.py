"""Scalar text functions: Column in, Column out, no Python on the executors but for non-ASCII normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character as Unicode has it; \w and \b of Java are ASCII unless told otherwise.
WORD = r"[\p{L}\p{N}_]"
NO_SOURCE = "(no_source)"
#: The range of amounts that count as prices.
LEAST_AMOUNT, MOST_AMOUNT = 0.0, 10_000_000.0
#: Widths of evidence snippets.
CONTEXT, SNIPPET, MATCHED = 170, 520, 120


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normalized(text: Column) -> Column:
    """LF line ends, and one blank for each run of blanks and tabs."""
    return F.regexp_replace(newlines(text), "[ \t]+", " ")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column, ascii_only: bool = False) -> Column:
    """Normal form C.  ``ascii_only`` promises ASCII and keeps the plan free of Python; else only other texts go there in full."""
    if ascii_only:
        return text
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(_nfc(F.when(~plain, text)))


def posix_path(path: Column, ascii_only: bool = False) -> Column:
    """Forward slashes, normal form C, no empty or ``.`` parts."""
    parts = F.split(nfc(F.replace(path, F.lit("\\"), F.lit("/")), ascii_only), "/")
    return F.array_join(F.filter(parts, lambda x: ~x.isin("", ".")), "/")


def short_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def record_id(path: Column, ascii_only: bool = False) -> Column:
    """Stable id of a path, the same for either slash and either normal form."""
    return short_id(posix_path(path, ascii_only))


def date_in(name: Column, patterns: list[str]) -> Column:
    """Y-M-D from the first pattern (three groups) that matches, else blank; the calendar is not consulted."""
    found = [F.when(name.rlike(p), F.concat_ws("-", *[F.regexp_extract(name, p, k) for k in (1, 2, 3)])) for p in patterns]
    return F.coalesce(*found, F.lit(""))


def source_in(path: Column, root: list[str]) -> Column:
    """The folder below ``root`` (a run of folder names, anywhere in the path), blanks collapsed; blank if there is none.

    The last part is the file itself and is no source.
    """
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    n = len(root)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - n - 1, F.lit(1))), lambda i: F.slice(parts, i, F.lit(n)) == F.array(*map(F.lit, root)))
    name = F.when((F.size(at) > 0) & (F.size(parts) > n + 1), F.get(parts, F.get(at, F.lit(0)) + n - 1))
    return F.coalesce(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")


def chars(text: Column) -> Column:
    return F.length(text).cast("long")


def filled(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) != ""


def combined(*texts: Column) -> Column:
    """The texts that are not blank, a blank line between them."""
    return F.concat_ws("\n\n", *[F.when(filled(t), t) for t in texts])


def source_or_none(source: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit(NO_SOURCE))


def amount(text: Column) -> Column:
    """Canonical decimal text of an amount in range (8 places, no trailing zeros), else null."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    number = plain.try_cast("double")
    fits = (number > LEAST_AMOUNT) & (number <= MOST_AMOUNT)
    return F.when(fits, F.regexp_replace(plain.try_cast("decimal(18,8)").cast("string"), r"\.?0+$", ""))


def currency(before: Column, after: Column, aliases: dict[str, str] | None = None) -> Column:
    """The code before the amount, or after it, in upper case and by its alias; else ``unspecified``."""
    code = F.upper(F.coalesce(F.nullif(F.trim(before), F.lit("")), F.nullif(F.trim(after), F.lit(""))))
    if aliases:
        known = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.upper(), v)])
        code = F.coalesce(F.element_at(known, code), code)
    return F.coalesce(code, F.lit("unspecified"))


def config_fingerprint(config: Column) -> Column:
    """Hash of a map's JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))), 256)


def cache_key(image_sha: Column, config_sha: Column) -> Column:
    return F.sha2(F.concat_ws(":", image_sha, config_sha), 256)


def term_count(text: Column, term: str) -> Column:
    """How often the literal term occurs, in any case, not inside a longer word."""
    quoted = r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    return F.regexp_count(text, F.lit(f"(?iu)(?<!{WORD}){quoted}(?!{WORD})")).cast("long")


def defanged(text: Column) -> Column:
    """Addresses that no longer work as links.  Fixed values: what is replaced by what."""
    for old, new in (("http://", "hxxp://"), ("https://", "hxxps://"), (".onion", "[.]onion")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def snippet(text: Column, start: Column, end: Column) -> Column:
    """What stands around a match (0-based, end exclusive), white space collapsed, addresses defanged."""
    low = F.greatest(start - CONTEXT, F.lit(0))
    part = text.substr((low + 1).cast("int"), (end + CONTEXT - low).cast("int"))
    return F.left(defanged(F.trim(F.regexp_replace(part, r"(?U)\s+", " "))), F.lit(SNIPPET))


def band(hits: Column, patterns: Column, sources: Column) -> Column:
    """Match intensity: high, medium, low or none."""
    return (
        F.when((hits >= 5) & (patterns >= 2) & (sources >= 1), "high")
        .when((hits >= 2) | (patterns >= 2), "medium")
        .when(hits >= 1, "low")
        .otherwise("none")
    )


def image_reference(ref: Column, ascii_only: bool = False) -> Column:
    """struct(path, status): a reference trimmed, unquoted, decoded; status unsafe, external or local.

    A drive or a leading slash is unsafe; a scheme or a host is external.  A
    plus sign stays one; what cannot be decoded stays as it is.
    """
    bare = F.trim(F.regexp_replace(F.trim(ref), "^<|>$", ""))
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    path = F.replace(nfc(decoded, ascii_only), F.lit("\\"), F.lit("/"))
    status = F.when(path.rlike("^[A-Za-z]:/") | path.rlike("^/([^/]|$)"), "unsafe").when(path.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|//)"), "external").otherwise("local")
    return F.struct(path.alias("path"), status.alias("status"))


def safe_path(path: Column) -> Column:
    """The path with ``.`` and ``..`` resolved; null if it is absolute, has a drive or a NUL, or leaves its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    none = F.lit(None).cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        return (
            F.when(stack.isNull(), none)
            .when(part.isin("", "."), stack)
            .when((part == "..") & (F.size(stack) == 0), none)
            .when(part == "..", F.slice(stack, F.lit(1), F.size(stack) - 1))
            .otherwise(F.concat(stack, F.array(part)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    bad = path.rlike("^[A-Za-z]:") | path.startswith("/") | path.startswith("\\") | path.contains("\0")
    return F.when(~bad & (F.size(kept) > 0), F.array_join(kept, "/"))


#: The decisions that coders give.
DECISIONS = ("present", "absent", "ambiguous", "insufficient_text", "not_applicable")


def decision(text: Column) -> Column:
    """One of the five decisions, blank, or null where the value is none of them."""
    value = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(value.isin("", *DECISIONS), value)


def machine_flag(text: Column) -> Column:
    """True or false, null where the value is neither."""
    value = F.lower(F.trim(text))
    return F.when(value.isin("1", "present", "true", "yes"), True).when(value.isin("0", "absent", "false", "no"), False)


def weight(text: Column) -> Column:
    """A finite positive weight, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (value > 0) & (value < float("inf")), value)


def final_decision(first: Column, second: Column, adjudicated: Column | None = None) -> Column:
    """With an adjudication sheet its value, blank or not; without one what both coders say, else blank."""
    if adjudicated is not None:
        return F.coalesce(adjudicated, F.lit(""))
    return F.when(first == second, first).otherwise(F.lit(""))
