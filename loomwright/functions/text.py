"""Column expressions that clean and take apart text and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months' names.
MONTHS = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")

# Phrases of a portal's navigation; a passage with two or more is no content.
BOILERPLATE = (
    "portal gov.br", "acesso rápido", "órgãos do governo", "acesso à informação", "entrar com o login", "navegação",
    "mapa do site", "fale conosco", "voltar ao topo",
)


def strip_quotes(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit('"'), F.lit("")))


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def decimal_comma(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def thousands_dot(c: Column) -> Column:
    return decimal_comma(F.replace(c, F.lit("."), F.lit("")))


def strip_space(c: Column) -> Column:
    """Python's strip: white space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD from ISO dates, ISO timestamps and MM/DD/YYYY; empty for all else."""
    return (
        F.when(c.rlike(r"^\d{4}-.{5}"), F.substring(c, 1, 10))
        .when(c.rlike(r"^..\/.{3}\d{4}"), F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 1, 2), F.substring(c, 4, 2)))
        .otherwise("")
    )


def year_or_unknown(c: Column) -> Column:
    iso = iso_date(c)
    return F.when(iso == "", "desconhecido").otherwise(F.substring(iso, 1, 4))


def month_mixed(c: Column) -> Column:
    """First of the month from DD/MM/YYYY or MM/YYYY."""
    full = F.when(c.rlike(r"^\d{1,2}/\d{4}$"), F.concat(F.lit("01/"), c)).otherwise(c)
    return F.trunc(F.try_to_date(full, "d/M/yyyy"), "month")


def state_code(c: Column) -> Column:
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"/([A-Z]{2})\b", 1)
    return F.when(found == "", "NA").otherwise(found)


def is_boilerplate(c: Column) -> Column:
    low = F.lower(c)
    return sum((F.contains(low, F.lit(p)).cast("int") for p in BOILERPLATE), F.lit(0)) >= 2


def is_degenerate(c: Column, least: int = 5) -> Column:
    return F.length(strip_space(c)) < least


def clean_html(c: Column) -> Column:
    """Scripts, styles and tags out, common entities decoded, white space collapsed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def tokens_unicode(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def citations(c: Column) -> Column:
    """Distinct number/year citations, thousands dots taken out, sorted."""
    found = F.regexp_extract_all(c, F.lit(r"\d[\d.]{2,7}\s*/\s*\d{4}"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.\s]", ""))))


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def window_starts(c: Column, size: int, overlap: int) -> Column:
    """Starts of sliding windows; the last is the first that reaches the end."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(c) - overlap) / F.lit(step))).cast("int")
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def windows_plain(c: Column, size: int, overlap: int) -> Column:
    """Starts of sliding windows up to the last character, wholly covered last ones included."""
    return F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def split_articles(c: Column) -> Column:
    parts = F.split(c, r"(?=\bArt(?:igo)?\.?\s*\d+)")
    return F.filter(F.transform(parts, strip_space), lambda p: p != "")


def pack_greedy(blocks: Column, most: int) -> Column:
    """Neighbouring blocks joined by line ends while they fit in ``most`` characters."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, block: Column) -> Column:
        done, held = acc.getField("done"), acc.getField("open")
        joined = F.when(held == "", block).otherwise(F.concat(held, F.lit("\n"), block))
        fits = F.length(joined) <= most
        flushed = F.when(held == "", done).otherwise(F.concat(done, F.array(held)))
        return F.struct(F.when(fits, done).otherwise(flushed).alias("done"), F.when(fits, joined).otherwise(block).alias("open"))

    return F.aggregate(blocks, state, step, lambda a: F.when(a.getField("open") == "", a.getField("done")).otherwise(F.concat(a.getField("done"), F.array(a.getField("open")))))
