"""Normalisation of names and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .romanize import romanized

# Accented letters and what they fold to.
ACCENTS = {
    "á": "a", "à": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "ā": "a",
    "é": "e", "è": "e", "ê": "e", "ë": "e", "ē": "e",
    "í": "i", "ì": "i", "î": "i", "ï": "i", "ī": "i",
    "ó": "o", "ò": "o", "ô": "o", "ö": "o", "õ": "o", "ø": "o", "ō": "o",
    "ú": "u", "ù": "u", "û": "u", "ü": "u", "ū": "u",
    "ý": "y", "ÿ": "y",
    "ñ": "n", "ç": "c", "ß": "ss",
    "æ": "ae", "œ": "oe",
    "đ": "d", "ł": "l", "š": "s", "ž": "z", "č": "c", "ř": "r", "ń": "n",
}
# Tokens that a name's blocking key leaves out.
LEGAL_SUFFIXES = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "lc", "llp", "lp", "plc", "ltd", "limited", "holdings",
    "holding", "group", "enterprises", "enterprise", "the", "and", "pvt", "private", "pl", "opc", "sarl", "sas", "sasu", "sa", "eurl",
    "sci", "snc", "limittedd", "limitted", "limittett", "limirrrrdd", "limitedd", "praaivett", "praiveett", "praaibhett", "piraiveett",
    "praivrrrr", "praaivet", "praa", "li", "elelpii", "prai",
]
# Address abbreviations. "st" is left alone, as it may be a street or a saint.
ABBREVIATIONS = {
    "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "hwy": "highway", "pkwy": "parkway", "cir": "circle", "trl": "trail", "ste": "suite", "apt": "apartment", "bldg": "building",
    "fl": "floor", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast",
    "sw": "southwest", "nagar": "nagar", "mkt": "market", "rly": "railway", "opp": "opposite", "nr": "near",
}


def fold(c: Column) -> Column:
    """Null as empty, lower case, accents folded."""
    out = F.lower(F.coalesce(c, F.lit("")))
    single = {k: v for k, v in ACCENTS.items() if len(v) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for k, v in ACCENTS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def strip_marks(c: Column) -> Column:
    """& as a word; apostrophes vanish; other marks and underscores separate words; single spaces."""
    out = F.replace(c, F.lit("&"), F.lit(" and "))
    out = F.translate(out, "'’ʼ`", "")
    out = F.regexp_replace(out, r"(?U)[^\w\s]+|_", " ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def normalized(c: Column) -> Column:
    return strip_marks(fold(c))


def tokens(c: Column) -> Column:
    """Tokens of normalised text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_key(norm: Column) -> Column:
    """A normalised name without legal suffixes, tokens sorted; one of nothing but suffixes stays as it is."""
    kept = F.filter(tokens(norm), lambda t: ~t.isin(LEGAL_SUFFIXES))
    return F.when(F.size(kept) == 0, norm).otherwise(F.array_join(F.array_sort(kept), " "))


def expanded(norm: Column) -> Column:
    """Address abbreviations written out, order kept."""
    words = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(F.split(norm, " "), lambda t: F.coalesce(words[t], t)), " ")


def address_key(addr_norm: Column) -> Column:
    return F.array_join(F.array_sort(tokens(addr_norm)), " ")


def numbers(c: Column) -> Column:
    """Runs of digits, sorted as text, repeats kept."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1)), " ")


def has_non_ascii(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[^\x00-\x7F]")


def normalize(df: DataFrame, romanise: bool = True, flags_after: bool = False) -> DataFrame:
    """df (business_name, business_address) with name_norm, name_block, addr_norm, addr_block, addr_nums, name_non_ascii and
    addr_non_ascii. With romanise the two columns themselves are romanised. The flags are those of the raw columns, as they are
    meant to tell names in other scripts; flags_after takes them after romanisation."""
    raw = {"name": F.coalesce("business_name", F.lit("")), "addr": F.coalesce("business_address", F.lit(""))}
    flags = {f"{k}_non_ascii": has_non_ascii(c) for k, c in raw.items()}
    df = df.withColumns({} if flags_after else flags)
    df = df.withColumns({"business_name": raw["name"], "business_address": raw["addr"]})
    if romanise:
        df = df.withColumns({c: romanized(F.col(c)) for c in ("business_name", "business_address")})
    if flags_after:
        df = df.withColumns({"name_non_ascii": has_non_ascii(F.col("business_name")), "addr_non_ascii": has_non_ascii(F.col("business_address"))})
    df = df.withColumns({"name_norm": normalized(F.col("business_name")), "addr_norm": expanded(normalized(F.col("business_address")))})
    return df.withColumns({"name_block": name_key(F.col("name_norm")), "addr_block": address_key(F.col("addr_norm")), "addr_nums": numbers(F.col("business_address"))})


def record_columns(df: DataFrame) -> DataFrame:
    """Lengths in characters and tokens of the normalised text, and whether the record is of source 3."""
    size = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, " ")))
    return df.withColumns(
        {"name_len": F.length("name_norm"), "addr_len": F.length("addr_norm"), "name_tokens": size("name_norm"), "addr_tokens": size("addr_norm"), "is_s3": F.col("entity_id").startswith("S3-").cast("double")}
    )
