"""Curves over scores, calibration, paired comparisons and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import extract
from ..functions import text as clean

# The routes of a question, in order, and the words that ask for each.
ROUTES = {
    "regulatorio": (
        "resolução", "resolucao", "norma", "regra", "vale-pedágio", "vale-pedagio", "tarifa", "rntrc", "regula", "legislação",
        "legislacao", "lei", "obrigató",
    ),
    "entidades": (
        "entidade", "extraia", "extrair", "identifique as", "quais órgãos", "quais orgaos", "quais leis", "trecho", "ementa", "cite as",
    ),
    "dados": (
        "volume", "praça", "praca", "ranking", "maior", "líder", "lider", "tráfego", "trafego", "crescimento", "acumulado",
        "quantos veículos", "quantos veiculos",
    ),
}


def first_of(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order``, with their ``rank`` from 1; Spark keeps k rows of
    each group before it shuffles."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def at_or_above(scored: DataFrame, score: str, label: str, cells: int = 4096) -> DataFrame:
    """(s, p, q, tp, fp) by distinct score: rows of label 1 and 0 at the score, and at it or above.

    Scores are first counted, then cut into cells by their magnitude, 64 to a doubling, and these
    into cells of equal width, so that neither a long tail nor a narrow range puts them all into one.
    Running sums inside cells and over the cells, a few thousand, are added. Null scores and labels
    take no part.
    """
    by = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(label).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("q")
    )
    ends = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    place = F.coalesce(F.floor((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * cells), F.lit(0))
    size = F.floor(F.log2(F.abs("s")) * 64) + 100_000  # above 0 for any double
    magnitude = F.when(F.col("s") > 0, size).when(F.col("s") < 0, -size).otherwise(0)
    held = by.crossJoin(F.broadcast(ends)).select("s", "p", "q", F.struct(magnitude.alias("m"), place.alias("w")).alias("cell"))
    higher = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("cell").agg(F.sum("p").alias("cp"), F.sum("q").alias("cq"))
    base = sums.select("cell", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_base") for c in ("cp", "cq")])
    inside = Window.partitionBy("cell").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumn("tp", F.sum("p").over(inside)).withColumn("fp", F.sum("q").over(inside))
    return run.join(F.broadcast(base), "cell").select(
        "s", "p", "q", (F.col("tp") + F.col("cp_base")).alias("tp"), (F.col("fp") + F.col("cq_base")).alias("fp")
    )


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under precision and recall as a sum of steps, one for each distinct score."""
    c = at_or_above(scored, score, label)
    step = F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return c.agg(F.round(F.sum(step) / F.nullif(F.sum("p"), F.lit(0)), 6).alias("average_precision"))


def best_f1(scored: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the largest F1 of ``score >= threshold``; of equal ones the smallest."""
    c = at_or_above(scored, score, label)
    total = c.agg(F.sum("p").alias("total"))
    f1 = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("total")), 6)
    return c.crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def best_youden(curve: DataFrame) -> DataFrame:
    """The point of a threshold sweep with the largest J; of equal ones the lowest threshold."""
    return curve.orderBy(F.desc("youden"), "threshold").limit(1)


def cascade(curve: DataFrame, share: Column, targets: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """For each target the point of the largest coverage whose specificity reaches it, with the share of
    calls it avoids where ``share`` of all questions can be answered, and of those the share lost.
    Targets that no point reaches give no row."""
    wanted = curve.select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")).filter("specificity >= target")
    first = Window.partitionBy("target").orderBy(F.desc("coverage"), "threshold")
    best = wanted.withColumn("r", F.row_number().over(first)).filter("r = 1")
    avoided = (1 - share) * F.col("specificity") + share * (1 - F.col("coverage"))
    return best.select("target", "threshold", "specificity", "coverage", F.round(avoided, 4).alias("avoided"), F.round(1 - F.col("coverage"), 4).alias("lost"))


def brier(scored: DataFrame, probability: str, label: str) -> DataFrame:
    return scored.agg(F.round(F.avg(F.pow(F.col(probability) - F.col(label), F.lit(2.0))), 6).alias("brier"))


def reliability(scored: DataFrame, probability: str, label: str, bins: int = 10) -> DataFrame:
    """Mean probability and share of label 1 in bins of equal width; 1 falls in the last."""
    at = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    return scored.filter(F.col(probability).isNotNull()).groupBy(at.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg(probability), 6).alias("mean_probability"), F.round(F.avg(label), 6).alias("share")
    )


def perplexity(tokens: DataFrame, text: str, logprob: str) -> DataFrame:
    """Perplexity over all tokens and its mean over texts; tokens without a log probability do not count."""
    per = tokens.filter(F.col(logprob).isNotNull()).groupBy(text).agg((-F.sum(logprob)).alias("nll"), F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("n_tokens"), F.round(F.exp(F.sum("nll") / F.sum("n")), 3).alias("ppl_micro"), F.round(F.avg(F.exp(F.col("nll") / F.col("n"))), 3).alias("ppl_macro")
    )


def winner(first: Column, swapped: Column) -> Column:
    """Who wins two verdicts with the places swapped: only one that both orders agree on."""
    return F.when((first == "B") & (swapped == "A"), "ft").when((first == "A") & (swapped == "B"), "base").otherwise("empate")


def paired(series: DataFrame, model: str, naive: str) -> DataFrame:
    """Mean difference of two error columns, and the percentage of series in which ``model`` errs less."""
    both = series.filter(F.col(model).isNotNull() & F.col(naive).isNotNull())
    return both.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col(naive) - F.col(model)), 3).alias("mean_gain"),
        F.round(100.0 * F.count_if(F.col(model) < F.col(naive)) / F.count("*"), 1).alias("win_pct"),
    )


def routes(question: Column) -> Column:
    """The routes whose words a question holds, joined by commas; none gives an empty string."""
    low = F.lower(question)

    def holds(words: tuple[str, ...]) -> Column:
        found = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            found = found | F.contains(low, F.lit(w))
        return found

    return F.concat_ws(",", *[F.when(holds(words), name) for name, words in ROUTES.items()])


def neutral_context(c: Column) -> Column:
    """Retrieved text with what could pass for the end of a context or a change of role made blanks."""
    return F.regexp_replace(c, r"(?i)</?contexto>|\[/?INST\]|<\|[^|]*\|>", " ")


def two_rates(answers: DataFrame, impossible: str, declined: str) -> DataFrame:
    """How often what cannot be answered is declined, how often the rest is answered, and the mean of both."""
    i, d = F.col(impossible), F.col(declined)
    c = answers.agg(F.count_if(i).alias("n_impossible"), F.count_if(~i).alias("n_possible"), F.count_if(i & d).alias("_q"), F.count_if(~i & ~d).alias("_c"))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    quiet, cover = rate("_q", "n_impossible"), rate("_c", "n_possible")
    return c.select("n_impossible", "n_possible", F.round(quiet, 4).alias("quiet"), F.round(cover, 4).alias("coverage"), F.round((quiet + cover) / 2, 4).alias("balanced"))


def refusal_audit(answers: DataFrame, impossible: str, declined: str, doubtful: str) -> DataFrame:
    """How many refusals may be none, and the coverage if all of those were answers: an upper bound."""
    i, d, s = F.col(impossible), F.col(declined), F.col(doubtful)
    c = answers.agg(F.count_if(d).alias("n_refusals"), F.count_if(s).alias("n_doubtful"), F.count_if(s & ~i).alias("n_doubtful_possible"), F.count_if(~i).alias("_n"), F.count_if(~i & d).alias("_d"))
    most = F.round((F.col("_n") - F.col("_d") + F.col("n_doubtful_possible")) / F.nullif(F.col("_n"), F.lit(0)), 4)
    return c.select("n_refusals", "n_doubtful", "n_doubtful_possible", F.coalesce(most, F.lit(0.0)).alias("coverage_at_most"))


def citation_precision(cited: Column, context: Column) -> Column:
    """The share of the cited sources that the context holds; null where none is cited."""
    return F.size(F.array_intersect(cited, context)) / F.nullif(F.size(cited), F.lit(0))


def parsed_routes(said: Column, question: Column) -> Column:
    """The known routes of a model's JSON; those of the question's words where it has none or is none."""
    listed = F.from_json(F.nullif(F.regexp_extract(said, r"(?s)\{.*\}", 0), F.lit("")), "rotas array<string>").getField("rotas")
    known = F.array_join(F.filter(listed, lambda r: r.isin(*ROUTES)), ",")
    return F.coalesce(F.nullif(known, F.lit("")), routes(question))


def guard_report(cases: DataFrame) -> DataFrame:
    """Detections by layer and category of (layer, category, hit)."""
    g = cases.groupBy("layer", "category").agg(F.count("*").alias("n"), F.count_if("hit").alias("detected"))
    return g.withColumn("rate", F.round(F.col("detected") / F.col("n"), 3))


def answer_events(answers: DataFrame, blocked: Column, text: str, size: int) -> DataFrame:
    """``answers`` as events with ``seq``, ``kind``, ``part``: one block, or sources, pieces of text, end."""
    event = lambda kind, part: F.struct(F.lit(kind).alias("kind"), part.alias("part"))
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: event("text", F.substring(F.col(text), i * size + 1, F.lit(size))))
    whole = F.concat(F.array(event("sources", F.lit(""))), parts, F.array(event("end", F.lit(""))))
    rows = answers.select("*", F.posexplode(F.when(blocked, F.array(event("block", F.lit("")))).otherwise(whole)).alias("seq", "event"))
    return rows.select(*[c for c in answers.columns if c != text], "seq", "event.kind", "event.part")


def annotation_kit(ranking: DataFrame, chunks: DataFrame, seed: int = 42) -> DataFrame:
    """(query_id, chunk_id, distractor): each question's best chunk, and one by a hash that it did not find.

    Chunks are numbered by chunk_id, their key. A question draws a place by its hash, and takes the first from there on
    (going round) whose chunk it did not find: one of as many places as it found, and one more. A
    question that found all chunks has no distractor."""
    from .star import numbered

    placed = numbered(chunks.select("chunk_id"), "chunk_id", "_place")
    total = placed.agg(F.count("*").alias("_n"))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("long")
    asked = ranking.groupBy("query_id").agg(F.count("*").alias("_found")).crossJoin(F.broadcast(total)).filter("_found < _n")
    tried = asked.select("query_id", "_n", drawn.alias("_drawn"), F.explode(F.sequence(F.lit(0).cast("long"), "_found")).alias("_step")).withColumn("_place", F.pmod(F.col("_drawn") + F.col("_step"), "_n") + 1)
    met = tried.join(placed, "_place").join(ranking.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    other = met.groupBy("query_id").agg(F.min_by("chunk_id", "_step").alias("chunk_id"))
    best = ranking.filter("rank = 1").select("query_id", "chunk_id", F.lit(False).alias("distractor"))
    return best.unionByName(other.select("query_id", "chunk_id", F.lit(True).alias("distractor")))


def act_chunks(acts: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(chunk_id, key, chunk): windows of an act between its heading and the portal's foot, less navigation
    and remnants, numbered from 0 after that."""
    body = extract.cut_footer(extract.cut_header(F.col(text)))
    rows = acts.select(F.col(key), body.alias("_b")).withColumn("_w", F.transform(clean.window_starts(F.col("_b"), size, overlap), lambda i: F.substring(F.col("_b"), i + 1, F.lit(size))))
    kept = rows.select(key, F.posexplode(F.filter("_w", lambda p: ~clean.is_boilerplate(p) & ~clean.is_degenerate(p))).alias("_i", "chunk"))
    return kept.select(F.concat_ws("::", F.col(key).cast("string"), F.col("_i").cast("string")).alias("chunk_id"), key, "chunk")
