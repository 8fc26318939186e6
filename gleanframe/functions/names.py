"""Names that people give, and text that they search for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def name_of(text: str | None) -> str | None:
    """A folder's name: composed, without blanks around it; None if nothing is left or it has control characters."""
    if text is None:
        return None
    name = unicodedata.normalize("NFC", text).strip()
    return name if name and not any(unicodedata.category(c) in ("Cc", "Cf", "Cs") for c in name) else None


def key_of(text: str | None) -> str | None:
    """What two names of one folder share."""
    name = name_of(text)
    return None if name is None else unicodedata.normalize("NFC", name.casefold())


@F.pandas_udf(StringType())
def name_key(text: pd.Series) -> pd.Series:
    return text.map(key_of)


#: Characters of a query at most, categories that it may not have, and the word in the names of its letters.
LONGEST_QUERY, NOT_IN_QUERIES, SCRIPT = 4096, {"Cc", "Cs"}, "LATIN"


def _foreign(letter: str) -> bool:
    return SCRIPT not in unicodedata.name(letter, "").split(" ")


def latin_query(text: str, instead: str | None = None) -> str:
    """What a semantic query is encoded from: the text, or what is given instead of it, without blanks around it.

    Both are refused if they are blank, too long, or have control characters or surrogates; format characters are let through.
    The one that is encoded may have no letters of other scripts.
    """
    for given in (text, instead):
        if given is not None and (not given.strip() or len(given) > LONGEST_QUERY or NOT_IN_QUERIES & {*map(unicodedata.category, given)}):
            raise ValueError("blank, too long, or with control characters")
    encoded = text if instead is None else instead
    if any(map(_foreign, filter(str.isalpha, encoded))):
        raise ValueError("not in Latin script")
    return encoded.strip()
