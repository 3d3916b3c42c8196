"""Links and query highlights as columns; only addresses written as numbers go to Python."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 2048
# fixed values: words not worth marking
STOP = "the and are but can did does for from had has have her his how its not our she that their them then there these they this was were what when where which who why will with you your just into about".split()
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def private_addresses(host: pd.Series) -> pd.Series:
    """Whether a host written as an address is none of the open net; null for other hosts."""

    def one(text: str | None) -> bool | None:
        try:
            address = ipaddress.ip_address(text or "")
        except ValueError:
            return None
        inner = address.ipv4_mapped if address.version == 6 and address.ipv4_mapped else address
        return inner.is_multicast or not inner.is_global

    return host.map(one).astype(object)


def refusal(url: Column) -> Column:
    """Why a link cannot be used (too long, invalid, scheme, no host, credentials, private), or null."""
    link = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(link, _AUTHORITY, 1)
    address = F.regexp_replace(authority, "^.*@", "")
    in_brackets = address.startswith("[")
    host = F.when(in_brackets, F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(address, "^([^:]*)", 1))
    host = F.lower(F.regexp_replace(F.regexp_replace(host, "%.*$", ""), r"\.+$", ""))
    port = F.when(in_brackets, F.regexp_extract(address, r"^\[[^\]]*\](.*)$", 1)).otherwise(F.regexp_extract(address, "^[^:]*(.*)$", 1))
    broken = (in_brackets != address.contains("]")) | ~port.rlike(r"^(:[0-9]*)?$") | (F.coalesce(F.substring(port, 2, 20).try_cast("decimal(20,0)"), F.lit(0)) > 65535)
    number = F.when(host.contains(":") | host.rlike(r"^[0-9.]+$"), host)
    secret = F.pandas_udf(private_addresses, "boolean")(number)
    inner = ~host.contains(".") | host.rlike(r"\.(localhost|local|internal)$")
    return (
        F.when(F.length(link) > LONGEST, "too long")
        .when(broken, "invalid")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(host == "", "no host")
        .when(F.regexp_extract(authority, "^(.*)@", 1).rlike("[^:]"), "credentials")
        .when(F.coalesce(secret, inner), "private")
    )


def query_pattern(query: Column) -> Column:
    """A pattern of the words that start with one of the query's: three characters or more, no stopwords; null if none."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), lambda w: ~w.isin(STOP)))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")[\p{L}\p{N}]*")))


def highlights(text: Column, query: Column) -> Column:
    """The words to mark, in order."""
    return F.coalesce(F.regexp_extract_all(text, query_pattern(query), F.lit(0)), F.array().cast("array<string>"))


def excerpt(text: Column, query: Column, before: int = 60) -> Column:
    """Text from a word at most ``before`` characters before the first match; whole if the match is near the start or absent."""
    pattern = query_pattern(query)
    start = F.length(F.call_function("regexp_extract", text, F.concat(F.lit("(?s)^(.*?)"), pattern), F.lit(1)))  # characters before the match
    lead = F.substring(text, start - before + 1, F.lit(before))
    space = F.instr(lead, " ")
    rest = F.when(space > 0, F.substring(text, start - before + space + 1, F.length(text))).otherwise(F.substring(text, start + 1, F.length(text)))
    return F.when(F.coalesce(F.rlike(text, pattern), F.lit(False)) & (start > before), F.concat(F.lit("…"), rest)).otherwise(F.coalesce(text, F.lit("")))
