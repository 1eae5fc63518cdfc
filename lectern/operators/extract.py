"""Generators: one note in, many rows out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import ship
from .matching import ALL, Patterns, matched, term_mentions

#: What counts as an embedded or linked image, a dollar amount and an amount of a coin.  They stand as they
#: are, since what they make of odd texts decides the results: an embedded name runs on past its brackets to a later .png,
#: an amount may begin or end with commas, and blanks may lie between an amount and its code.
IMAGE = r"!\[\[(.*?\.png)(?:\|.*?)?\]\]|!\[[^\]]*\]\(([^)]*\.png)\)"
DOLLAR = r"(?<!\w)(?:(USD|AUD|CAD|NZD)\s*)?(\$)\s*([0-9][0-9,]*(?:\.\d{1,2})?)(?:\s*(USD|AUD|CAD|NZD))?(?!\w)"
COIN = r"(?<![\w.])([0-9]+(?:\.[0-9]+)?)\s*(BTC|XMR|USDT|bitcoin|monero)\b"
#: Codes of coins given by name, and what a dollar sign without a code gives.
COIN_NAMES = {"BITCOIN": "BTC", "MONERO": "XMR"}
NO_CODE = "UNSPECIFIED_DOLLAR"
PRICE_CONTEXT = 100


def spans(notes: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """One row a match: the note's columns but its text, match_index from 1, start, end, matched."""
    ship(notes.sparkSession)
    kept = [c for c in notes.columns if c != text]
    found = F.flatten(F.transform(matched(F.col(text), [(pattern,)], most=ALL, flags=0), lambda x: x["places"]))
    rows = notes.select(*kept, F.posexplode(found).alias("k", "m"))
    return rows.select(*kept, (F.col("k") + 1).alias("match_index"), "m.start", "m.end", "m.matched")


def image_references(notes: DataFrame, pattern: str = IMAGE) -> DataFrame:
    """note_id, ref_index (from 1), ref: the images a note embeds or links, in order.  The pattern's first group that took part is the name."""

    @F.arrow_udf("array<string>")
    def refs(texts: pa.Array) -> pa.Array:
        find = re.compile(pattern, re.IGNORECASE).finditer
        return pa.array([[r for m in find(t) if (r := next((g for g in m.groups() if g), "").strip())] if (t := x.as_py()) else [] for x in texts], pa.list_(pa.string()))

    worth = notes.where(F.contains("text", F.lit("![")))
    return worth.select("note_id", F.posexplode(refs("text")).alias("k", "ref")).select("note_id", (F.col("k") + 1).alias("ref_index"), "ref")


def keyword_counts(notes: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """note_id, source, keyword, count, present for every note and keyword, zeros too."""
    ship(notes.sparkSession)
    found = matched(F.col("text"), [(p,) for p in keywords.values()], flags=re.IGNORECASE | re.MULTILINE)
    counts = F.map_from_entries(F.transform(found, lambda x: F.struct(x["group"], x["hits"][0])))
    names = F.array(*map(F.lit, keywords))
    rows = notes.select("note_id", "source", counts.alias("by_group")).select("*", F.posexplode(names).alias("k", "keyword"))
    rows = rows.select("note_id", "source", "keyword", F.coalesce(F.try_element_at("by_group", F.col("k")), F.lit(0)).cast("long").alias("count"))
    return rows.withColumn("present", (F.col("count") > 0).cast("int"))


def entity_mentions(notes: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """note_id, source, entity_type, entity, count of the terms that occur."""
    return term_mentions(notes, [(kind, t) for kind, own in terms.items() for t in own])


def price_mentions(notes: DataFrame, dollar: str = DOLLAR, coin: str = COIN, names: dict[str, str] | None = None) -> DataFrame:
    """note_id, source, currency, amount, raw, context: dollar amounts first, then coins, in order.

    ``dollar`` has the groups code, sign, amount and code, ``coin`` amount and
    name.  Texts without a literal that a pattern needs are passed over.
    Amounts out of range are left out; white space in the context is collapsed.
    """
    ship(notes.sparkSession)
    schema = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "before", "after", "number", "raw", "context")]))

    @F.arrow_udf("array<struct<kind:string,before:string,after:string,number:string,raw:string,context:string>>")
    def found(texts: pa.Array) -> pa.Array:
        own = Patterns([(dollar,), (coin,)], re.IGNORECASE)

        def hits(t: str) -> Iterator[dict]:
            for group, _ in own.candidates(t):
                for m in own.compiled[group][0].finditer(t):
                    before, number, after = (m[1], m[3], m[4]) if group == 0 else (None, m[1], m[2])
                    context = " ".join(t[max(0, m.start() - PRICE_CONTEXT) : m.end() + PRICE_CONTEXT].split())
                    yield {"kind": ("dollar", "coin")[group], "before": before, "after": after, "number": number, "raw": m.group(), "context": context}

        return pa.array([list(hits(t)) if (t := x.as_py()) else [] for x in texts], schema)

    rows = notes.select("note_id", "source", F.explode(found("text")).alias("x")).select("note_id", "source", "x.*")
    code = T.currency(F.col("before"), F.col("after"), names or COIN_NAMES)
    rows = rows.withColumns({"currency": F.when((F.col("kind") == "dollar") & F.col("before").isNull() & F.col("after").isNull(), NO_CODE).otherwise(code), "amount": T.amount(F.col("number"))})
    return rows.where("amount IS NOT NULL").select("note_id", "source", "currency", "amount", "raw", "context")


def unordered_pairs(codes: DataFrame) -> DataFrame:
    """code_a < code_b over the distinct codes of a small dimension."""
    own = codes.select("code").distinct()
    a, b = own.select(F.col("code").alias("code_a")), own.select(F.col("code").alias("code_b"))
    return a.join(F.broadcast(b), F.col("code_a") < F.col("code_b"))


def pairs_of_cells(cells: DataFrame) -> DataFrame:
    """A table of counts (target, c1, c2, n) as one row a pair."""
    return cells.where("n > 0").select("target", "c1", "c2", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("pair"))
