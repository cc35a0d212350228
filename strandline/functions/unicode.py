"""Normalisation and parsing that Spark has no expression for, as pandas UDFs on Arrow batches. Nulls stay null."""

from __future__ import annotations

import ast
import re
import tomllib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Abbreviations after which a full stop ends no sentence, and characters that carry no text.
ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "eq.", "fig.", "sec.", "tab.")
INVISIBLE = "\u200b\u200c\u200d\ufeff\u00ad"

_DROP = {ord(c): None for c in INVISIBLE}


def _each(f, x: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v is pd.NA else f(v) for v in x.astype(object).where(x.notna(), None)], dtype=object)


def plain_identifier(v: str) -> str:
    """STR-12: NFKC, lower case, runs of non-word characters and underscores become one space."""
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", v).lower()).strip()


def plain_claim(v: str) -> str:
    """STR-13: NFKC, invisible characters dropped, words joined across line breaks, white space collapsed, lower case."""
    v = unicodedata.normalize("NFKC", v.translate(_DROP)).translate(_DROP)
    return " ".join(re.sub(r"(\w)-\s*\n\s*(\w)", r"\1\2", v).split()).lower()


def plain_line(v: str) -> str:
    """STR-14: NFKC, one kind of newline, no white space at the end."""
    return unicodedata.normalize("NFKC", v).replace("\r\n", "\n").replace("\r", "\n").rstrip()


def claim_sentences(v: str) -> list[str]:
    """STR-44: sentences of a claim group; list items stand alone, abbreviations do not end a sentence. The segmenter is
    our own: a sentence ends at . ! or ? before white space and a character that is not lower-case."""
    v, held = unicodedata.normalize("NFKC", v), "\x00"
    for word in ABBREVIATIONS:
        v = re.sub(re.escape(word), lambda m: m[0].replace(".", held), v, flags=re.I)
    out = []
    for line in re.split(r"\n+\s*(?:[-*•]\s+)?|\s[-*•]\s+", v):
        out += re.split(r"(?<=[.!?])\s+(?=[^a-z])", line)
    return [s.replace(held, ".").strip() for s in out if s.strip()]


def code_names(v: str) -> list[str]:
    """STR-50: lower-cased names, attributes and definitions of a Python snippet; none if it does not parse."""
    try:
        tree = ast.parse(v)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = set()
    for node in ast.walk(tree):
        for field in ("id", "attr", "name", "arg"):
            if isinstance(x := getattr(node, field, None), str):
                found.add(x.lower())
    return sorted(found)


def toml_dependencies(v: str) -> list[str]:
    """STR-38: dependency names of a pyproject file; none if it is not TOML."""
    try:
        data = tomllib.loads(v)
    except tomllib.TOMLDecodeError:
        return []
    project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    names = [re.match(r"[A-Za-z0-9_.-]*", d)[0] for d in project.get("dependencies", []) if isinstance(d, str)]
    names += [k for k in poetry if k != "python"]
    return list(dict.fromkeys(n.lower() for n in names if n))


@F.pandas_udf(StringType())
def normalize_identifier(x: pd.Series) -> pd.Series:
    return _each(plain_identifier, x)


@F.pandas_udf(StringType())
def normalize_claim(x: pd.Series) -> pd.Series:
    return _each(plain_claim, x)


@F.pandas_udf(StringType())
def normalize_line(x: pd.Series) -> pd.Series:
    return _each(plain_line, x)


@F.pandas_udf(ArrayType(StringType()))
def split_claims(x: pd.Series) -> pd.Series:
    return _each(claim_sentences, x)


@F.pandas_udf(ArrayType(StringType()))
def ast_tokens(x: pd.Series) -> pd.Series:
    return _each(code_names, x)


@F.pandas_udf(ArrayType(StringType()))
def pyproject_dependencies(x: pd.Series) -> pd.Series:
    return _each(toml_dependencies, x)
