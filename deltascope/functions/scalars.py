"""Coercions and small string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NULLS = ("", "nan", "none", "\\n")


def clean(c: Column) -> Column:
    """Text without outer white space; blank, nan, none and \\N in any case are null."""
    bare = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    return F.when(~F.lower(bare).isin(*_NULLS), bare)


def to_flag(c: Column) -> Column:
    """true and false from booleans and their texts (true/t/1, false/f/0); else null."""
    v = F.lower(clean(c))
    return F.when(v.isin("true", "t", "1"), True).when(v.isin("false", "f", "0"), False)


def to_long(c: Column) -> Column:
    """Whole numbers from numbers and texts, through double where the text has a point or an exponent."""
    v = clean(c)
    return F.when(v.rlike(r"[.eE]"), v.try_cast("double").try_cast("bigint")).otherwise(v.try_cast("bigint"))


def to_reservoir(c: Column) -> Column:
    """An unsigned 64-bit number; 2^63 and above mean none, and so do negative ones."""
    v = clean(c)
    n = F.when(v.rlike(r"[.eE]"), v.try_cast("double").try_cast("decimal(20,0)")).otherwise(v.try_cast("decimal(20,0)"))
    return F.when((n >= 0) & (n < F.lit("9223372036854775808").cast("decimal(20,0)")), n.cast("bigint"))


def address(c: Column) -> Column:
    return F.lower(c)


def parse_array(c: Column) -> Column:
    """array<bigint> from text such as [1,2]; null for other text."""
    return F.from_json(c, "array<bigint>")


def after_prefix(c: Column, prefix: str) -> Column:
    """The trimmed rest of texts that begin with prefix, else null."""
    return F.when(c.startswith(prefix), F.trim(F.substr(c, F.lit(len(prefix) + 1))))


def canonical_selector(c: Column) -> Column:
    """0x and eight lower-case hex digits; an 0x in front is optional; else null."""
    found = F.regexp_extract(F.lower(F.trim(c)), "^(?:0x)?([0-9a-f]{8})$", 1)
    return F.when(found != "", F.concat(F.lit("0x"), found))


def family(c: Column) -> Column:
    return F.substring(c, 1, 6)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is null or 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def owner_of(name: Column) -> Column:
    """The project in front of the first colon, lower case; null without one."""
    head = F.lower(F.trim(F.split(name, ":", 2)[0]))
    return F.when((F.instr(name, ":") > 0) & (head != ""), head)


# Words any of which a compiled name must contain, and its label; the first match wins. Then classifications and their labels.
NAME_LADDER = (
    (("entrypoint",), "ERC-4337 EntryPoint"),
    (("uniswap",), "Uniswap"),
    (("sushi",), "SushiSwap"),
    (("permit2",), "Uniswap Permit2"),
    (("aggregationrouter",), "1inch Aggregation Router"),
    (("universalrouter",), "Uniswap Universal Router"),
    (("safe", "gnosis"), "Safe"),
)
CLASSIFICATIONS = {"upgradeable": "Upgradeable Contract", "proxy": "Proxy", "wallet_or_safe": "Wallet / Safe"}


def label_from_name(name: Column, classification: Column, fallback: Column) -> Column:
    """A label from words in a compiled name, then from a classification, else fallback."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.coalesce(fallback, F.lit("unknown"))
    for kind, label in CLASSIFICATIONS.items():
        out = F.when(classification == kind, label).otherwise(out)
    out = F.when(low.contains("proxy") & (F.coalesce(classification, F.lit("")) != ""), F.concat(F.lit("Proxy ("), classification, F.lit(")"))).otherwise(out)
    for words, label in reversed(NAME_LADDER):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label).otherwise(out)
    return out


def is_precompile(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*[f"0x{i:040x}" for i in range(1, 11)]), F.lit(False))


def format_count(c: Column) -> Column:
    return F.format_number(c, 0)


def format_percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_number(100.0 * c, places), F.lit("%"))


def short_address(c: Column) -> Column:
    return F.when(F.length(c) > 12, F.concat(F.substring(c, 1, 6), F.lit("…"), F.right(c, F.lit(4)))).otherwise(c)


def humanize(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_+", " "))
