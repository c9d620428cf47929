"""Text functions: Column expressions first, an Arrow function only for NFC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: horizontal white space of Unicode, controls left out.
H_SPACE = "[ \\t\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Fixed value: control characters but line feed and tab.
CONTROL = "[\\u0000-\\u0008\\u000b-\\u001f\\u007f-\\u009f]"
WORD = r"(\p{L}+)"


def nfc(text: Column) -> Column:
    """NFC form; texts below U+0300 are in NFC already and do not reach Python."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.coalesce(compose(F.when(text.rlike("[^\\x00-\\u02ff]"), text)), text)


def normalized(text: Column) -> Column:
    """Line ends as LF, NFC, no controls, single blanks, trimmed lines, at most two blank lines in a row, none at the ends."""
    t = nfc(F.regexp_replace(text, "\\r\\n?", "\n"))
    t = F.regexp_replace(F.regexp_replace(t, CONTROL, ""), f"{H_SPACE}+", " ")
    t = F.regexp_replace(t, " ?\\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", ""), "\\n{4,}", "\n\n\n")


def words(text: Column) -> Column:
    """Runs of letters in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 1)


def lines(text: Column) -> Column:
    """Lines that are not empty."""
    return F.filter(F.split(text, "\n", -1), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Paragraphs parted by blank lines, with their content trimmed."""
    return F.filter(F.transform(F.split(text, "\\n{2,}", -1), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")), lambda x: x != "")


def blocks(text: Column, size: int = 3) -> Column:
    """Sliding blocks of ``size`` lines that are not empty."""
    own = lines(text)
    return F.when(F.size(own) >= size, F.transform(F.sequence(F.lit(1), F.size(own) - (size - 1)), lambda i: F.concat_ws("\n", F.slice(own, i, size)))).otherwise(F.array().cast("array<string>"))


def host(url: Column) -> Column:
    """Host of a URL with or without scheme: lower case, without user, port and final dots; null if there is none."""
    rest = F.regexp_replace(F.trim(url), "^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    name = F.regexp_replace(F.regexp_extract(rest, "^(?:[^/?#@]*@)?([^/?#:]*)", 1), "\\.+$", "")
    return F.nullif(F.lower(name), F.lit(""))


def registrable(name: Column) -> Column:
    """The last two labels of a host; three where the last two are a known public suffix."""
    labels = F.split(name, "\\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))
    return F.when(two.isin(*SUFFIXES), three).otherwise(two)


#: Public suffixes of two labels that are looked at.
SUFFIXES = ("co.uk", "com.br", "com.ar", "com.mx", "org.br", "gov.br", "com.pt", "org.uk", "com.au", "co.jp", "edu.br", "net.br")
#: Hosts of one family of encyclopaedias, themselves and all below them.
WIKI_HOSTS = ("wikipedia.org", "wikibooks.org", "wikidata.org", "wikimedia.org", "wikinews.org", "wikiquote.org", "wikisource.org", "wikiversity.org", "wikivoyage.org", "wiktionary.org")


def is_wiki(name: Column) -> Column:
    """Equal to one of WIKI_HOSTS or below it, never a mere part of a label; false for null."""
    return F.coalesce(name.rlike("(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in WIKI_HOSTS) + ")$"), F.lit(False))
