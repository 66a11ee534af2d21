"""Column expressions that take titles, states, sources, entities and JSON out of text, and small sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalise, strip_space

# What marks an act's heading, its passive revocation, the start of its body and a portal's foot.
TITLE = r"RESOLU[ÇC][ÃA]O\s+N[º°]\s*[\d.]+[^\n.]{0,200}"
HEADING = r"RESOLU[ÇC][ÃA]O\s+N"
REVOKED = r"Revogad[ao]s?\s+(?:expressamente\s+)?(?:pel[oa]s?|por)\b"
BODY = ("A Diretoria Colegiada", "O Diretor-Geral", "O DIRETOR", "R E S O L V E", "RESOLVE:")
FOOT = r"(?is)\s*Carregando\.{3}\s*Voltar ao Topo.*$"
#: Without a mark of the body the heading is looked for in this many characters; a whole act has more than LEAST.
HEAD, LEAST = 2000, 2500

# Answers that decline, the kinds of entities, and what a question about structured data asks for.
DECLINED = r"\bNOT_FOUND\b|\bnot (?:found|present|mentioned|specified|stated|contain)|\bno (?:mention|reference|information)\b|\bdoes not (?:contain|specify|mention)\b"
LONG_ANSWER = 240
KINDS = ("ORGANIZACAO", "PESSOA", "TEMPO", "LOCAL", "LEGISLACAO", "JURISPRUDENCIA")
PLACE = r"(?i)pra[çc]a\s+([\w\s./-]{2,40}?)(?:\?|$|\.|,| no | em | teve | tem )"
NO_PLACE = ("lider", "líder", "de", "com", "mais", "maior", "campeã", "campea")
RANKED = ("maior", "ranking", "líder", "lider", "top")
GROWN = ("crescimento", "cresceu", "variação", "variacao")


def title(c: Column) -> Column:
    """The act's own heading: in capitals if there is one, else in any case, else empty."""
    found = lambda p: F.nullif(F.regexp_extract(c, p, 0), F.lit(""))
    return strip_space(F.coalesce(found(TITLE), found("(?iu)" + TITLE), F.lit("")))


def in_force(c: Column) -> Column:
    """Whether nothing before the body says that the act was revoked."""
    marks = [F.nullif(F.instr(c, m), F.lit(0)) for m in BODY]
    cut = F.coalesce(F.least(*marks) - 1, F.lit(HEAD))
    return ~F.substring(c, F.lit(1), cut).rlike("(?i)" + REVOKED)


def valid_act(c: Column) -> Column:
    return c.rlike(TITLE) & (F.length(c) > LEAST)


def cut_header(c: Column) -> Column:
    """``c`` from its first heading on; whole if it has none."""
    rest = F.regexp_extract(c, "(?isu)" + HEADING + ".*", 0)
    return F.when(rest == "", c).otherwise(rest)


def cut_footer(c: Column) -> Column:
    return F.regexp_replace(c, FOOT, "")


def category(c: Column) -> Column:
    found = F.regexp_extract(c, 'related to "([^"]+)"', 1)
    return F.when(found == "", "desconhecida").otherwise(found)


def search_text(c: Column) -> Column:
    """Category and details of a question without what all questions say."""
    details = strip_space(F.regexp_extract(c, r"(?s)Details:\s*(.*)", 1))
    return strip_space(F.concat(category(c), F.lit(" "), details))


def preview(c: Column, most: int = 320) -> tuple[Column, Column]:
    return F.substring(c, 1, most), F.length(c) > most


def shorter(a: Column, b: Column) -> tuple[Column, Column]:
    """Both texts cut to the length of the shorter."""
    n = F.least(F.length(a), F.length(b))
    return F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n)


def numbered(texts: Column) -> Column:
    """``[i] text``, with empty lines between."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def sources_context(passages: Column, neutral) -> Column:
    """Numbered sources (number, in_force, text) between marks, their texts made neutral by ``neutral``."""
    said = lambda p: F.when(p.getField("in_force"), "vigente").otherwise("revogada")
    one = lambda p, i: F.concat(
        F.lit("[Fonte "), (i + 1).cast("string"), F.lit(" — Resolução "), p.getField("number"), F.lit(" ("), said(p), F.lit(")]\n"), neutral(p.getField("text"))
    )
    return F.concat(F.lit("<contexto>\n"), F.array_join(F.transform(passages, one), "\n\n"), F.lit("\n</contexto>"))


def first_object(c: Column, schema: str) -> Column:
    """The first flat ``{...}`` of a text; null where there is none or it is no JSON."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"\{[^{}]*\}", 0), F.lit("")), schema)


def entities(c: Column) -> Column:
    """Distinct (texto, tipo) of known kinds in the first JSON array of a text, the texts normalised."""
    rows = F.from_json(F.regexp_extract(c, r"(?s)\[.*\]", 0), "array<struct<texto: string, tipo: string>>")
    known = F.filter(F.coalesce(rows, F.array().cast("array<struct<texto: string, tipo: string>>")), lambda e: e.getField("texto").isNotNull() & e.getField("tipo").isin(*KINDS))
    return F.array_distinct(F.transform(known, lambda e: F.struct(normalise(e.getField("texto")).alias("texto"), e.getField("tipo").alias("tipo"))))


def clamp(c: Column, most: float = 1.0) -> Column:
    """A score between 0 and ``most``; 0 for what is none."""
    return F.coalesce(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(float(most))), F.lit(0.0))


def clamp_whole(c: Column, most: int = 2) -> Column:
    """A score rounded half to even, between 0 and ``most``."""
    return clamp(F.bround(c.cast("double"), 0), most).cast("int")


def bio_spans(tokens: Column, tags: Column) -> Column:
    """(text, kind) of the entities of B-, I- and O tags. An I- that continues no entity of its kind
    ends the one before and starts none."""
    state = F.struct(F.array().cast("array<struct<text: string, kind: string>>").alias("done"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("kind"))
    closed = lambda a: F.when(a.getField("text").isNull(), a.getField("done")).otherwise(
        F.concat(a.getField("done"), F.array(F.struct(a.getField("text").alias("text"), a.getField("kind").alias("kind")))))

    def step(a: Column, x: Column) -> Column:
        token, tag = x.getField("token"), x.getField("tag")
        kind = F.substring(tag, 3, 100)
        begins, goes_on = tag.startswith("B-"), tag.startswith("I-") & F.coalesce(a.getField("kind") == kind, F.lit(False))
        return F.struct(
            F.when(goes_on, a.getField("done")).otherwise(closed(a)).alias("done"),
            F.when(begins, token).when(goes_on, F.concat(a.getField("text"), F.lit(" "), token)).alias("text"),
            F.when(begins | goes_on, kind).alias("kind"),
        )

    both = F.transform(F.arrays_zip(tokens.alias("token"), tags.alias("tag")), lambda x: F.struct(x.getField("token").alias("token"), x.getField("tag").alias("tag")))
    return F.aggregate(both, state, step, closed)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def declined(answer: Column) -> Column:
    return answer.rlike("(?i)" + DECLINED)


def doubtful_refusal(answer: Column) -> Column:
    """A refusal that is long or cites a passage, and so may be none."""
    return declined(answer) & ((F.length(answer) > LONG_ANSWER) | answer.rlike(r"\[\d+\]"))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(c, F.lit(-500.0)), F.lit(500.0))))


def cross_entropy(p: Column, y: Column, eps: float = 1e-12) -> Column:
    held = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(held) + (1 - y) * F.log(1 - held))


def three_digits(c: Column) -> Column:
    """Rounded to three digits by the number's exact binary value, where the JVM rounds its shortest decimal."""
    return F.pandas_udf(lambda s: s.map(lambda v: float(f"{v:.2e}"), na_action="ignore"), "double")(c)


def binomial_p(k: Column, n: Column) -> Column:
    """Two-sided exact p of the smaller of two discordant counts: 2 P(X <= k; n, 1/2), at most 1."""
    log_choose = lambda i: F.aggregate(F.when(i > 0, F.sequence(F.lit(1), i.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, j: a + F.log((n - j + 1) / j))
    total = F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda a, i: a + F.exp(log_choose(i) - n * F.log(F.lit(2.0))))
    return F.when(n > 0, F.least(F.lit(1.0), 2 * total)).otherwise(1.0)


def chi2_p(x: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom: erfc(sqrt(x / 2)), by its
    series below 6 and by its continued fraction above."""
    z = F.sqrt(x / 2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("term"), z.alias("sum")),
        lambda a, i: F.struct((-a.getField("term") * z * z / i).alias("term"), (a.getField("sum") - a.getField("term") * z * z / i / (2 * i + 1)).alias("sum")),
        lambda a: 1 - 2 / F.sqrt(F.pi()) * a.getField("sum"),
    )
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda a, i: z + (i / 2.0) / a)
    return F.when(x < 6, series).otherwise(F.exp(-z * z) / F.sqrt(F.pi()) / fraction)


def cost_per_thousand(usd_hour: Column, per_second: Column, rate: float, share: float) -> tuple[Column, Column, Column]:
    """Of a machine that answers ``per_second``: cost of 1000 requests when full, when used by ``share``, and a month's."""
    month = usd_hour * 24 * 30 * rate
    full = 1000.0 / per_second / 3600.0 * usd_hour * rate
    return F.round(full, 3), F.round(month / (per_second * 3600 * 24 * 30 * share / 1000.0), 3), F.round(month, 0)


def cost_by_latency(usd_hour: Column, seconds: Column, rate: float, share: float) -> tuple[Column, Column]:
    full = seconds * 1000 / 3600.0 * usd_hour * rate
    return F.round(full, 2), F.round(full / share, 2)


def data_intent(question: Column) -> Column:
    """(place, ranking, growth) that a question about structured data asks for."""
    place = F.trim(F.regexp_extract(question, PLACE, 1))
    low = F.lower(question)
    some = lambda words: F.greatest(*[F.contains(low, F.lit(w)) for w in words])
    named = (place != "") & ~F.lower(place).isin(*NO_PLACE)
    ranking = some(RANKED) | ~named
    return F.struct(F.when(named, place).alias("place"), ranking.alias("ranking"), (ranking & some(GROWN)).alias("growth"))


def link_texts(html: Column, kind: str = "RES") -> Column:
    """(kind, num, seq, year, body) of the calls LinkTexto('kind','num','seq','year','body'...) of one kind."""
    call = r"LinkTexto\('([^']+)','(\d+)','(\d+)','(\d+)','([^']*)'"
    found = F.regexp_extract_all(html, F.lit(call), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, call, i)
    rows = F.transform(found, lambda x: F.struct(part(x, 1).alias("kind"), part(x, 2).alias("num"), part(x, 3).alias("seq"), part(x, 4).alias("year"), part(x, 5).alias("body")))
    return F.filter(rows, lambda r: r.getField("kind") == kind)
