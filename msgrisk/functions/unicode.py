"""Arrow functions for the few Unicode steps Spark has no expression for.

Callers apply them to distinct, pre-filtered values (see ``needs_unicode``), never to whole
message tables.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgrisk.functions import text as tx


def needs_unicode(host: Column) -> Column:
    return host.contains("xn--") | host.rlike(r"[^\x00-\x7f]")


@F.pandas_udf(T.StringType())
def decode_idna(hosts: pd.Series) -> pd.Series:
    def label(text):
        try:
            return text.encode("ascii").decode("idna")
        except UnicodeError:
            return text

    return hosts.map(lambda h: None if h is None else ".".join(label(x) for x in h.lower().strip(".").split(".")))


@F.pandas_udf(T.StringType())
def encode_idna(hosts: pd.Series) -> pd.Series:
    def encode(host):
        try:
            return host.encode("idna").decode("ascii").lower().rstrip(".")
        except UnicodeError:
            return ""

    return hosts.map(lambda h: None if h is None else encode(h))


@F.pandas_udf(T.StringType())
def _decompose(values: pd.Series) -> pd.Series:
    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return values.map(lambda v: None if v is None else plain(v.casefold()))


def confusable_skeleton(value: Column) -> Column:
    """Full skeleton: compatibility decomposition without marks, then the mapped letters."""
    return F.translate(_decompose(value), *tx.CONFUSABLES)


@F.pandas_udf(T.ArrayType(T.StringType()))
def non_latin_segments(texts: pd.Series, minimum: pd.Series) -> pd.Series:
    """Passages of one non-Latin script with at least ``minimum`` letters."""

    def script(ch):
        name = unicodedata.name(ch, "")
        if name.startswith(("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "HIRAGANA ", "KATAKANA ")):
            return "cjk"
        if not unicodedata.category(ch).startswith("L"):
            return None
        return "latin" if name.startswith("LATIN ") else name.split(" ", 1)[0]

    def passages(text, least):
        found, run, current, letters = [], [], None, 0
        for ch in [*text, "a"]:  # a Latin letter closes the last passage
            kind = script(ch)
            if kind and kind != current:
                if current and letters >= least:
                    found.append("".join(run).strip())
                run, current, letters = [], None if kind == "latin" else kind, 0
            if current and kind:
                run.append(ch)
                letters += 1
            elif current and run[-1] != " ":
                run.append(" ")
        return found

    return pd.Series([None if t is None else passages(t, m) for t, m in zip(texts, minimum)])
