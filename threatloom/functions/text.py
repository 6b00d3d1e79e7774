"""Names and labels: canonical form, closed-charset checks, entropy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# The character sets accepted at the trust boundary.
ID_PATTERN = r"\A[A-Za-z0-9_.:\-]{1,128}\z"
LABEL_PATTERN = r"\A[A-Za-z0-9_.\-/:]{1,128}\z"
CLIENT_PATTERN = r"\A[A-Za-z0-9_.:\-]{1,128}\z"
FQDN_PATTERN = r"\A[a-z0-9_-]+(\.[a-z0-9_-]+)*\z"
ARTIFACT_UNSAFE = r"[^A-Za-z0-9_.:\-= ]"
URL_UNSAFE = r'[ \t\r\n;"\\]'
CONTROL_CHARS = r"[\x00-\x1f\x7f-\x9f]"


def _matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def valid_id(text: Column) -> Column:
    return _matches(text, ID_PATTERN)


def valid_label(text: Column) -> Column:
    return _matches(text, LABEL_PATTERN)


def valid_client(text: Column) -> Column:
    return _matches(text, CLIENT_PATTERN)


def strip_dots(name: Column) -> Column:
    return F.regexp_replace(name, r"\.+\z", "")


def label_lengths_ok(name: Column) -> Column:
    return (F.length(name) <= 253) & F.forall(F.split(name, r"\."), lambda label: F.length(label) <= 63)


def valid_fqdn(name: Column) -> Column:
    """Exact-name form an exported artifact may carry (one trailing dot allowed)."""
    bare = F.regexp_replace(name, r"\.\z", "")
    return _matches(bare, FQDN_PATTERN) & label_lengths_ok(bare)


@F.pandas_udf(T.StringType())
def _idna(names: pd.Series) -> pd.Series:
    def encode(name):
        if name is None:
            return None
        try:
            return name.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return names.map(encode)


def idna_name(name: Column) -> Column:
    """ASCII form of a name, null where IDNA refuses it. ASCII names are taken as they are; others are encoded in Python."""
    return F.when(name.rlike(r"\A[\x00-\x7f]*\z"), name).otherwise(_idna(F.when(~name.rlike(r"\A[\x00-\x7f]*\z"), name)))


def canonical_fqdn(value: Column, idna: bool = False) -> Column:
    """Canonical name or null. ``idna`` sends only non-ASCII names to Python."""
    name = F.lower(strip_dots(F.trim(value)))
    ascii_only = name.rlike(r"\A[\x00-\x7f]*\z")
    if idna:
        encoded = F.when(ascii_only, name).otherwise(_idna(F.when(~ascii_only, name)))
    else:
        encoded = F.when(ascii_only, name)
    return F.when(_matches(encoded, FQDN_PATTERN) & label_lengths_ok(encoded), encoded)


def canonical_url(value: Column) -> Column:
    url = F.trim(value)
    return F.when(~url.rlike(URL_UNSAFE) & (F.length(url) <= 2048), url)


def artifact_safe(text: Column) -> Column:
    """Render text inert for a zone comment or rule option; empty becomes '_'."""
    cleaned = F.regexp_replace(text, ARTIFACT_UNSAFE, "_")
    return F.when(cleaned == "", F.lit("_")).otherwise(cleaned)


def leftmost_label(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def label_depth(name: Column) -> Column:
    return F.size(F.split(name, r"\.")).cast("long")


def domain_under(name: Column, suffix: Column) -> Column:
    """True when ``name`` equals ``suffix`` or lies below it."""
    return (name == suffix) | name.endswith(F.concat(F.lit("."), suffix))


def name_suffixes(name: Column) -> Column:
    """Every suffix of a dotted name, the name itself first."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."),
    )


def entropy_microbits(text: Column) -> Column:
    """Shannon entropy per character in millionths of a bit, rounded half-even."""
    size = F.length(text)
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    counts = F.array_sort(F.transform(letters, lambda c: size - F.length(F.replace(text, c, F.lit("")))))
    log_size = F.log2(size.cast("double"))
    total = F.aggregate(
        counts, F.lit(0.0), lambda acc, n: acc + n * (log_size - F.log2(n.cast("double"))))
    bits = F.bround(total / size * F.lit(1_000_000.0), 0).cast("long")
    return F.when(size > 1, bits).otherwise(F.lit(0).cast("long"))
