"""Personal data masks and prompt-injection patterns as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked, in this order, and the label put in its place.
PII = (
    (r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "[CNPJ]"),
    (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", "[CPF]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    (r"\(?\d{2}\)?\s?9\d{4}-?\d{4}\b", "[TELEFONE]"),
    (r"\b\d{5}-\d{3}\b", "[CEP]"),
    (r"\b\d{11}\b", "[CPF]"),
)

# Names of injection patterns and the patterns, the first that matches names the case.
INJECTION = (
    ("ignorar-instrucoes", r"ignore\s+(as\s+|todas\s+as\s+)?(instru[çc][õo]es|regras|orienta)"),
    ("esquecer-instrucoes", r"esque[çc]a\s+(as\s+|tudo)"),
    ("desconsiderar", r"desconsidere\s+(as\s+|o\s+)?(instru|regras|acima|anterior)"),
    ("ignore-en", r"ignore\s+(?:all\s+|previous\s+)*(instructions|rules|the\s+above)"),
    ("disregard-en", r"disregard\s+(all|previous|the)"),
    ("exfiltrar-prompt", r"(revele|mostre|exiba|repita|imprima)\s+(?:o\s+|a\s+|os\s+|as\s+|seu\s+|sua\s+|seus\s+|suas\s+)*(prompt|sistema|system|instru)"),
    ("system-prompt", r"system\s*prompt"),
    ("trocar-persona", r"voc[êe]\s+(agora\s+)?[ée]\s+(um|uma|o|a)\b"),
    ("trocar-persona-en", r"you\s+are\s+now\b|act\s+as\s+"),
    ("jailbreak", r"developer\s+mode|modo\s+desenvolvedor|jailbreak"),
    ("marcadores-role", r"\[/?INST\]|<\|[^|]*\|>|###\s*(system|instruction)"),
)

#: What the patterns call a character of a word, a digit and white space, in Unicode, as Java writes it.
WORD, DIGIT, BLANK = r"\p{L}\p{N}_", r"\p{Nd}", r"[\t-\r\x1C-\x20\x85\p{Z}]"


def unicode_pattern(pattern: str) -> str:
    """A pattern of PII over all of Unicode. An address is looked for once from where its characters begin
    or the last match ended, so that a long run of them is passed in one go; the signs that no word end
    separates from what stands before are the first group."""
    if "@" in pattern:
        return rf"(?:(?<=[{WORD}])\G|(?<![{WORD}.+-])([.+-]*+)(?=[{WORD}]))[{WORD}.+-]++@[{WORD}-]++\.[{WORD}.-]*[{WORD}]"
    bare = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\d", DIGIT).replace(r"\s", BLANK)
    before, after = f"(?<![{WORD}])" if pattern.startswith(r"\b") else "", f"(?![{WORD}])" if pattern.endswith(r"\b") else ""
    return before + bare + after


def mask_pii(c: Column) -> Column:
    """Personal data replaced by its label, pattern by pattern. Texts without two digits in a row, or
    without an @, pass the patterns that need them unread."""
    numbers = c.rlike(DIGIT + "{2}")

    def masked(c: Column, digits: bool) -> Column:
        for pattern, label in PII:
            if "@" in pattern:
                c = F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, unicode_pattern(pattern), "$1" + label)).otherwise(c)
            elif digits:
                c = F.regexp_replace(c, unicode_pattern(pattern), label)
        return c

    return F.when(numbers, masked(c, True)).otherwise(masked(c, False))


def plain_ascii(c: Column) -> Column:
    """Compatibility forms taken apart and what is not ASCII left out. Only texts that hold such
    characters go to Python."""

    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")

    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, F.pandas_udf(of, "string")(F.when(odd, c))).otherwise(c)


def fold_latin(c: Column) -> Column:
    """Accents off, other non-ASCII out, lower case, runs of white space and punctuation as one space."""
    return F.regexp_replace(F.lower(plain_ascii(c)), r"[\s\W]+", " ")


def injection(c: Column) -> Column:
    """Name of the first injection pattern found in the text or its folded form, or null."""
    folded, out = fold_latin(c), None
    for name, pattern in INJECTION:
        hit = c.rlike("(?iu)" + pattern) | folded.rlike("(?iu)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out
