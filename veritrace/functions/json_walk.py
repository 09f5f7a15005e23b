"""Everything inside a JSON document, at any depth, in one pass over its text.

JSON's tokens are regular: strings (with a colon, names), numbers, words, and the brackets that open something. Read
in order, a value is the token after its name, whatever is nested around it. No level is a job of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_TOKEN = _STRING + r'(?:\s*+:)?|[{\[]|-?[0-9][0-9.eE+-]*+|true|false|null'


def _plain(token: Column) -> Column:
    """A string token without quotes and escapes; other tokens as they are."""
    text = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(~token.startswith('"'), token).when(~text.contains("\\"), text).otherwise(F.get_json_object(F.concat(F.lit("["), token, F.lit("]")), "$[0]"))


def _scalar(token: Column) -> Column:
    return ~token.isin("{", "[") & ~token.endswith(":")


def leaves(json: Column) -> Column:
    """All strings, numbers and truth values of a document that are values: array<string>, in order; nulls are none."""
    kept = lambda t: F.filter(t, lambda x: _scalar(x) & (x != "null"))
    return F.transform(kept(F.regexp_extract_all(json, F.lit(_TOKEN), F.lit(0))), _plain)


def named(json: Column, name: str) -> Column:
    """The scalar values that stand under a name, at any depth: array<string>. A name whose value is an object or
    array has none of its own."""
    said = re.escape('"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"')
    # Strings are passed over as wholes, so that the name is met as one only; what follows it is all that is kept.
    one = rf'{said}\s*+:\s*+({_STRING}|-?[0-9][0-9.eE+-]*+|true|false)|{_STRING}'
    return F.transform(F.filter(F.regexp_extract_all(json, F.lit(one), F.lit(1)), lambda x: x != ""), _plain)
