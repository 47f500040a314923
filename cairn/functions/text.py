"""Scalar text functions as Column expressions (no Python in the tasks, but for one fallback)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocabulary as V

#: Python's white space: Java's Unicode class and the four separators that it leaves out.
WS = r"(?U)[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def hash_text(c: Column) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(strip(c).cast("binary"), 256)


def word_tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def split_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, f"\n{WS}*\n"), strip), lambda p: p != "")


def split_sentences(c: Column) -> Column:
    """Parts between white space that follows a full stop, exclamation or question mark."""
    return F.split(c, f"(?<=[.!?]){WS}+")


def title_case(c: Column) -> Column:
    """Upper case after anything that isn't a letter, lower case after a letter."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def normalize_tradition(c: Column) -> Column:
    collapsed = F.array_join(word_tokens(c), " ")
    return F.when(collapsed != "", title_case(collapsed))


def _plain_letters() -> tuple[str, str]:
    """Letters up to U+024F and U+1E00-1EFF that decompose to one ASCII letter and marks, and that letter."""
    have, want = [], []
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(n)) if not unicodedata.combining(ch))
        if len(base) == 1 and base.isascii():
            have.append(chr(n))
            want.append(base)
    return "".join(have), "".join(want)


def entity_key(name: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one blank; marks are dropped. Names in other scripts have an empty key.

    Knows the letters of the table only; with_entity_key() is exact for all names."""
    have, want = _plain_letters()
    bare = F.regexp_replace(F.translate(name, have, want), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def entity_key_any(name: pd.Series) -> pd.Series:
    """entity_key() for names with ligatures and other many-letter decompositions; apply it to distinct names."""
    bare = name.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())
    return bare.str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def with_entity_key(rows: DataFrame, name: str = "display_name", key: str = "normalized_key") -> DataFrame:
    """`rows` with the key of each name. Distinct names with characters beyond ASCII after the table get theirs in Python."""
    rest = F.coalesce(F.translate(F.col(name), *_plain_letters()).rlike(r"[^\x00-\x7F]"), F.lit(False))
    rows = rows.drop(key)
    exact = rows.where(rest).select(name).distinct().withColumn(key, entity_key_any(F.col(name)))
    return rows.where(~rest).withColumn(key, entity_key(F.col(name))).unionByName(rows.where(rest).join(exact, name))


def query_text(question: Column) -> Column:
    return F.concat(F.lit(V.QUERY_PREFIX), question)


def source_label(title: Column, tradition: Column) -> Column:
    named = F.when(tradition != "", F.concat(F.lit("an untitled "), tradition, F.lit(" source")))
    return F.coalesce(F.nullif(title, F.lit("")), named, F.lit("an untitled source"))


def provenance_label(position: Column, role: Column, era: Column, flags: Column) -> Column:
    tags = [F.nullif(F.translate(c, "_", " "), F.lit("")) for c in (position, role, era)]
    return F.concat_ws(", ", *tags, F.concat(F.lit("flagged: "), F.nullif(flags, F.lit(""))))


def search_query(entity_type: Column, name: Column) -> Column:
    return F.concat(name, F.when(entity_type == "institution", F.lit(" history publisher institution")).otherwise(F.lit(" biography")))


def provenance_rank(position: Column) -> Column:
    return F.when(position == "indigenous_primary_text", 0).when(position == "indigenous_scholar", 1).otherwise(2)


def violations(fields: dict[str, Column]) -> Column:
    """Names of the fields whose value is outside its vocabulary or length; nulls pass."""
    found = []
    for name, c in fields.items():
        if name in V.ENUMS:
            bad = ~c.isin(*V.ENUMS[name])
        else:
            least, most = V.LENGTHS[name]
            bad = F.char_length(c) < least
            if most is not None:
                bad = bad | (F.char_length(c) > most)
        found.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*found))
