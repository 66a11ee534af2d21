"""Registered queries of the expressions that take fields, titles, sources, entities and JSON out of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import evaluation
from .registry import iso_said, iso_sql, query

# --- fields of delimited files, made from the tables' numbers and dates ---------------------------


# Each field is written by one expression that both engines read, marred in several ways; the pattern is then
# applied to it on both sides.

QUOTED = """CASE c_custkey % 4 WHEN 0 THEN ' "' || c_name || '" ' WHEN 1 THEN '"' || c_name WHEN 2 THEN c_name || ' ""x"" ' ELSE c_name END"""


@query(f"SELECT c_custkey, trim(replace({QUOTED}, '\"', '')) AS name FROM customer")
def prj_strip_quotes(t):
    return t.customer.select("c_custkey", text.strip_quotes(F.expr(QUOTED)).alias("name"))


NUMBERED = """CASE event_id % 6 WHEN 0 THEN user_id || 'x' WHEN 1 THEN ' ' || user_id || ' ' WHEN 2 THEN '-' || user_id WHEN 3 THEN '' WHEN 4 THEN '12345678901234567890' || user_id ELSE CAST(user_id AS STRING) END"""


@query(f"SELECT event_id, coalesce(TRY_CAST({NUMBERED} AS BIGINT), 0) AS n FROM events")
def prj_to_int_null(t):
    return t.events.select("event_id", F.coalesce(text.to_long(F.expr(NUMBERED)), F.lit(0)).alias("n"))


COMMA = "replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING), '.', ',')"
PRICED = f"CASE o_orderkey % 5 WHEN 0 THEN '-' || {COMMA} WHEN 1 THEN 'n/d' WHEN 2 THEN ',5' WHEN 3 THEN ' ' || {COMMA} ELSE {COMMA} END"


@query(f"SELECT o_orderkey, TRY_CAST(replace({PRICED}, ',', '.') AS DOUBLE) AS price FROM orders")
def prj_decimal_comma(t):
    return t.orders.select("o_orderkey", text.decimal_comma(F.expr(PRICED)).alias("price"))


DOTTED = """CASE o_orderkey % 4 WHEN 0 THEN '' ELSE (o_orderkey % 999 + 1) || '.' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || CASE o_orderkey % 4 WHEN 1 THEN '.000' WHEN 2 THEN ',x' ELSE '' END || ',' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') END"""


@query(f"SELECT o_orderkey, TRY_CAST(replace(replace({DOTTED}, '.', ''), ',', '.') AS DOUBLE) AS price FROM orders")
def prj_thousands_dot(t):
    return t.orders.select("o_orderkey", text.thousands_dot(F.expr(DOTTED)).alias("price"))


@query("SELECT upper(trim('  ' || c_mktsegment || ' ')) AS segment, count(*) AS n FROM customer GROUP BY 1")
def prj_trim_upper(t):
    return t.customer.groupBy(F.upper(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT lower(trim('  ' || c_mktsegment || ' ')) AS segment, count(*) AS n FROM customer GROUP BY 1")
def prj_trim_lower(t):
    return t.customer.groupBy(F.lower(F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))).alias("segment")).agg(F.count("*").alias("n"))


DATED = """CASE o_orderkey % 6 WHEN 0 THEN lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || year(o_orderdate)
    WHEN 1 THEN month(o_orderdate) || '/' || year(o_orderdate) WHEN 2 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || year(o_orderdate) WHEN 3 THEN '31/02/' || year(o_orderdate)
    WHEN 4 THEN 'em ' || year(o_orderdate) ELSE lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || year(o_orderdate) END"""


@query(f"""SELECT o_orderkey, strftime(date_trunc('month', try_strptime(CASE WHEN regexp_full_match(said, '[0-9]{{1,2}}/[0-9]{{4}}') THEN '01/' || said ELSE said END, '%d/%m/%Y')), '%Y-%m-%d') AS month
    FROM (SELECT o_orderkey, {DATED} AS said FROM orders)""")
def dt_month_mixed(t):
    return t.orders.select("o_orderkey", F.date_format(text.month_mixed(F.expr(DATED)), "yyyy-MM-dd").alias("month"))


@query(iso_sql("event_id", "ts", "events"))
def dt_iso_formats(t):
    """Dates of a stream's time stamps, as the dates of orders in ``dt_iso_multi``."""
    said = F.expr(iso_said("event_id", "ts"))
    return t.events.select("event_id", text.iso_date(said).alias("iso"), text.year_or_unknown(said).alias("year"))


PLACED_AT = """CASE n_nationkey % 4 WHEN 0 THEN 'BR-116/' || upper(substr(n_name, 1, 2)) || ' km 3' WHEN 1 THEN 'BR-116/' || upper(substr(n_name, 1, 3)) WHEN 2 THEN 'a/b ' || n_name || '/DF/SP' ELSE n_name END"""


@query(f"SELECT n_nationkey, coalesce(nullif(regexp_extract({PLACED_AT}, '/([A-Z]{{2}})\\b', 1), ''), 'NA') AS state FROM nation")
def str_uf(t):
    return t.nation.select("n_nationkey", text.state_code(F.expr(PLACED_AT)).alias("state"))


# --- text of acts and portals ----------------------------------------------------------------------

# an act as the portal shows it, around each document; which marks it has hangs on the id
ACT = """(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Portal gov.br  Acesso rápido ' END) || (CASE WHEN doc_id % 5 = 0 THEN 'Resolução nº ' WHEN doc_id % 7 = 0 THEN '' ELSE 'RESOLUÇÃO Nº ' END)
    || doc_id || ', de 2020' || chr(10) || (CASE WHEN doc_id % 4 = 0 THEN 'Revogada pela Resolução 1' ELSE 'Revoga a Resolução 2' END) || (CASE WHEN doc_id % 6 = 0 THEN '' ELSE ' A Diretoria Colegiada ' END)
    || text || ' Revogado por outra - Seção 1 Carregando... Voltar ao Topo' || chr(10) || 'fim'"""
ACTS = f"(SELECT doc_id, {ACT} AS act FROM documents WHERE text IS NOT NULL)"
HEAD_END = "least(" + ", ".join(f"coalesce(nullif(strpos(act, '{m}'), 0) - 1, 1000000000)" for m in extract.BODY) + ")"


def acts(t):
    i = F.col("doc_id")
    lit = F.lit
    act = F.concat(
        F.when(i % 3 == 0, "").otherwise("Portal gov.br  Acesso rápido "), F.when(i % 5 == 0, "Resolução nº ").when(i % 7 == 0, "").otherwise("RESOLUÇÃO Nº "),
        i.cast("string"), lit(", de 2020\n"), F.when(i % 4 == 0, "Revogada pela Resolução 1").otherwise("Revoga a Resolução 2"),
        F.when(i % 6 == 0, "").otherwise(" A Diretoria Colegiada "), F.col("text"), lit(" Revogado por outra - Seção 1 Carregando... Voltar ao Topo\nfim"),
    )
    return t.documents.filter("text is not null").select("doc_id", act.alias("act"))


@query(f"""SELECT doc_id, trim(coalesce(nullif(regexp_extract(act, '{extract.TITLE}', 0), ''), nullif(regexp_extract(act, '(?i){extract.TITLE}', 0), ''), '')) AS title FROM {ACTS}""")
def str_title(t):
    return acts(t).select("doc_id", extract.title(F.col("act")).alias("title"))


@query(f"""SELECT doc_id, NOT regexp_matches(substr(act, 1, CASE WHEN {HEAD_END} = 1000000000 THEN 2000 ELSE {HEAD_END} END), '(?i){extract.REVOKED}') AS in_force FROM {ACTS}""")
def str_in_force(t):
    return acts(t).select("doc_id", extract.in_force(F.col("act")).alias("in_force"))


@query(f"SELECT doc_id, regexp_matches(act, '{extract.TITLE}') AND length(act) > 2500 AS valid FROM {ACTS}")
def flt_valid_doc(t):
    return acts(t).select("doc_id", extract.valid_act(F.col("act")).alias("valid"))


@query(f"SELECT doc_id, md5(CASE WHEN regexp_matches(act, '(?i){extract.HEADING}') THEN regexp_extract(act, '(?is){extract.HEADING}.*', 0) ELSE act END) AS digest FROM {ACTS}")
def str_cut_header(t):
    return acts(t).select("doc_id", F.md5(extract.cut_header(F.col("act"))).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(act, '{extract.FOOT}', '')) AS digest FROM {ACTS}")
def str_cut_footer(t):
    return acts(t).select("doc_id", F.md5(extract.cut_footer(F.col("act"))).alias("digest"))


@query(f"""SELECT doc_id, ({' + '.join(f"CAST(contains(lower(act), '{p}') AS INTEGER)" for p in text.BOILERPLATE)}) >= 2 AS chrome FROM {ACTS}""")
def flt_boilerplate(t):
    return acts(t).select("doc_id", text.is_boilerplate(F.col("act")).alias("chrome"))


@query("""SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) < 5""")
def flt_degenerate(t):
    line = t.documents.select(F.explode(F.split("text", "\n")).alias("line"))
    return line.filter(text.is_degenerate(F.col("line"))).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, i - 1 AS part, md5(p) AS digest FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id,
    list_filter(list_transform(string_split(regexp_replace('Art. 1 ' || text || ' Art. 2 Artigo 3 end', '\\b(Art(?:igo)?\\.?\\s*\\d+)', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps
    FROM documents WHERE text IS NOT NULL))""")
def chk_split_articles(t):
    whole = F.concat(F.lit("Art. 1 "), F.col("text"), F.lit(" Art. 2 Artigo 3 end"))
    return t.documents.filter("text is not null").select("doc_id", F.posexplode(text.split_articles(whole)).alias("part", "p")).select("doc_id", F.col("part").cast("long").alias("part"), F.md5("p").alias("digest"))


@query("SELECT doc_id, unnest(range(0, length(text), 1300)) AS start FROM documents WHERE length(text) > 0")
def chk_window_plain(t):
    return t.documents.select("doc_id", F.explode(text.windows_plain(F.col("text"), 1500, 200).cast("array<bigint>")).alias("start"))


@query("SELECT item_id, sha256(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g')) AS slug FROM (SELECT item_id, regexp_replace(text, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS text FROM benchmark)")
def str_slug(t):
    return t.benchmark.select("item_id", F.sha2(text.slug(F.col("text")).cast("binary"), 256).alias("slug"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
def str_norm_ws(t):
    return t.documents.select("doc_id", F.md5(text.normalise(F.col("text"))).alias("digest"))


@query("SELECT doc_id, substr(text, 1, 320) AS preview, length(text) > 320 AS cut FROM documents")
def str_preview(t):
    head, cut = extract.preview(F.col("text"))
    return t.documents.select("doc_id", head.alias("preview"), cut.alias("cut"))


@query("SELECT l.item_id, left(l.text, least(length(l.text), length(r.text))) AS a, left(r.text, least(length(l.text), length(r.text))) AS b FROM benchmark l JOIN benchmark r ON r.item_id = l.item_id + 1")
def str_truncate_pair(t):
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    one, two = extract.shorter(F.col("text"), F.col("other"))
    return t.benchmark.join(b, "item_id").select("item_id", one.alias("a"), two.alias("b"))


QUESTION = """'Highlight the parts' || CASE WHEN item_id % 3 = 0 THEN '' ELSE ' related to "' || split_part(text, ' ', 1) || '"' END || ' that should be reviewed.' || CASE WHEN item_id % 4 = 0 THEN '' ELSE ' Details:  ' || text || chr(10) || 'more' END"""


def questions(t):
    i = F.col("item_id")
    asked = F.concat(
        F.lit("Highlight the parts"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(' related to "'), F.element_at(F.split("text", " "), 1), F.lit('"'))),
        F.lit(" that should be reviewed."), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit(" Details:  "), F.col("text"), F.lit("\nmore"))),
    )
    return t.benchmark.select("item_id", asked.alias("question"))


CATEGORY = """coalesce(nullif(regexp_extract(question, 'related to "([^"]+)"', 1), ''), 'desconhecida')"""


@query(f"SELECT item_id, {CATEGORY} AS category FROM (SELECT item_id, {QUESTION} AS question FROM benchmark)")
def str_category(t):
    return questions(t).select("item_id", extract.category(F.col("question")).alias("category"))


@query(f"""SELECT item_id, regexp_replace({CATEGORY} || ' ' || regexp_replace(regexp_extract(question, '(?s)Details:\\s*(.*)', 1), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS asked FROM (SELECT item_id, {QUESTION} AS question FROM benchmark)""")
def str_query_build(t):
    return questions(t).select("item_id", extract.search_text(F.col("question")).alias("asked"))


CITED = "'see ' || (doc_id % 9 + 1) || '.' || lpad(CAST(doc_id AS VARCHAR), 3, '0') || ' / 2023 and 5867/2020, ' || text"


def citing(t):
    i = F.col("doc_id")
    return t.documents.filter("text is not null").select("doc_id", F.concat(F.lit("see "), (i % 9 + 1).cast("string"), F.lit("."), F.lpad(i.cast("string"), 3, "0"), F.lit(" / 2023 and 5867/2020, "), F.col("text")).alias("said"))


CITATIONS = "list_sort(list_distinct(list_transform(regexp_extract_all(said, '\\d[\\d.]{2,7}\\s*/\\s*\\d{4}'), lambda x: regexp_replace(x, '[.\\s]', '', 'g'))))"
CITING = f"(SELECT doc_id, {CITED} AS said FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({CITATIONS}, ';') AS cited FROM {CITING}")
def str_citations(t):
    return citing(t).select("doc_id", F.array_join(text.citations(F.col("said")), ";").alias("cited"))


@query(f"SELECT doc_id, len(list_intersect({CITATIONS}, ['1001/2023', '5867/2020', '2002/2023'][1:1 + doc_id % 3])) > 0 AS right_source, len({CITATIONS}) > 0 AS any_source FROM {CITING}")
def str_cites_expected(t):
    expected = F.slice(F.array(*[F.lit(s) for s in ("1001/2023", "5867/2020", "2002/2023")]), F.lit(1), (1 + F.col("doc_id") % 3).cast("int"))
    cited = text.citations(F.col("said"))
    return citing(t).select("doc_id", F.arrays_overlap(cited, expected).alias("right_source"), (F.size(cited) > 0).alias("any_source"))


TOP = "(SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents WHERE text IS NOT NULL QUALIFY r <= 3)"


@query(f"SELECT source, md5(string_agg('[' || r || '] ' || text, chr(10) || chr(10) ORDER BY r)) AS digest FROM {TOP} GROUP BY 1")
def str_context_simple(t):
    ranked = evaluation.first_of(t.documents.filter("text is not null"), "source", ["n_chars", "doc_id"], 3)
    texts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x.getField("text"))
    return ranked.groupBy("source").agg(texts.alias("texts")).select("source", F.md5(extract.numbered(F.col("texts"))).alias("digest"))


@query(f"""SELECT source, md5('<contexto>' || chr(10) || string_agg('[Fonte ' || r || ' — Resolução ' || doc_id || ' (' || CASE WHEN doc_id % 2 = 0 THEN 'vigente' ELSE 'revogada' END || ')]' || chr(10)
    || regexp_replace(text, '</?contexto>|\\[/?INST\\]|<\\|[^|]*\\|>', ' ', 'gi'), chr(10) || chr(10) ORDER BY r) || chr(10) || '</contexto>') AS digest FROM {TOP} GROUP BY 1""")
def str_source_heading(t):
    ranked = evaluation.first_of(t.documents.filter("text is not null"), "source", ["n_chars", "doc_id"], 3)
    passage = F.struct("rank", F.col("doc_id").cast("string").alias("number"), (F.col("doc_id") % 2 == 0).alias("in_force"), "text")
    rows = ranked.groupBy("source").agg(F.sort_array(F.collect_list(passage)).alias("p"))
    return rows.select("source", F.md5(extract.sources_context(F.col("p"), evaluation.neutral_context)).alias("digest"))


# --- entities, JSON, sets, numbers --------------------------------------------------------------------

# words of each text, tagged by what stands before a colon of their position: B, I and O in turn
TAGS = ("B-PESSOA", "I-PESSOA", "O", "I-LOCAL", "B-LOCAL", "I-LOCAL", "I-PESSOA", "B-TEMPO")
WORDS = "(SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM benchmark)"


@query(f"""WITH x AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS i, {list(TAGS)} AS tags FROM {WORDS}), y AS (SELECT item_id, word, i, tags[CAST((i + item_id) % 8 AS INTEGER) + 1] AS tag FROM x),
    k AS (SELECT *, substr(tag, 3) AS kind, lag(substr(tag, 3)) OVER (PARTITION BY item_id ORDER BY i) AS before FROM y),
    g AS (SELECT *, sum(CASE WHEN tag LIKE 'B-%' OR tag = 'O' OR kind <> coalesce(before, '') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) AS run FROM k)
    SELECT item_id, string_agg(word, ' ' ORDER BY i) AS entity, min(kind) AS kind, count(*) AS n FROM g GROUP BY item_id, run HAVING arg_min(tag, i) LIKE 'B-%'""")
def arr_bio_spans(t):
    words = t.benchmark.select("item_id", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    tags = F.transform("w", lambda x, i: F.element_at(F.array(*[F.lit(g) for g in TAGS]), ((i + F.col("item_id")) % 8 + 1).cast("int")))
    found = words.select("item_id", F.explode(extract.bio_spans(F.col("w"), tags)).alias("e"))
    return found.select("item_id", F.col("e.text").alias("entity"), F.col("e.kind").alias("kind"), F.size(F.split("e.text", " ")).cast("long").alias("n"))


ANSWERED = """CASE doc_id % 6 WHEN 0 THEN 'no object, {broken' WHEN 1 THEN 'Answer: {"nota": ' || CAST(doc_id % 7 AS STRING) || '.25, "x": "' || source || '"} end {"nota": 9}'
    WHEN 2 THEN '{not json} {"nota": 1, "x": "late"}' WHEN 3 THEN 'a {"nota": -2.5, "x": null} b' WHEN 4 THEN '{"x": {"nota": 3, "x": "inner"}}' ELSE '{"x": "' || lang || '", "nota": 4e0}' END"""
FOUND = f"(SELECT doc_id, CASE WHEN json_valid(o) THEN o END AS o FROM (SELECT doc_id, nullif(regexp_extract({ANSWERED}, '\\{{[^{{}}]*\\}}'), '') AS o FROM documents))"


@query(f"SELECT doc_id, json_extract_string(o, '$.x') AS x, CAST(json_extract_string(o, '$.nota') AS DOUBLE) AS score FROM {FOUND}")
def json_first_object(t):
    got = extract.first_object(F.expr(ANSWERED), "nota double, x string")
    return t.documents.select("doc_id", got.getField("x").alias("x"), got.getField("nota").alias("score"))


@query(f"""SELECT doc_id, coalesce(least(greatest(n, 0), 1), 0) AS unit, CAST(coalesce(least(greatest(round_even(n, 0), 0), 2), 0) AS INTEGER) AS grade
    FROM (SELECT doc_id, CAST(json_extract_string(o, '$.nota') AS DOUBLE) AS n FROM {FOUND})""")
def json_score_clamp(t):
    got = extract.first_object(F.expr(ANSWERED), "nota double").getField("nota")
    return t.documents.select("doc_id", extract.clamp(got).alias("unit"), extract.clamp_whole(got).alias("grade"))


KNOWN = "', '".join(extract.KINDS)


LISTED = """CASE doc_id % 5 WHEN 0 THEN 'nothing' WHEN 1 THEN 'So: [{"texto": "' || upper(source) || '", "tipo": "PESSOA"}, {"texto": "  ' || source || ' ", "tipo": "PESSOA"}, {"texto": "' || lang || '", "tipo": "COISA"}] done'
    WHEN 2 THEN '[{"texto": null, "tipo": "LOCAL"}, {"tipo": "LOCAL"}, {"texto": "' || lang || '", "tipo": "LOCAL"}]' WHEN 3 THEN '[broken, {"texto": "x"' ELSE '[' || chr(10) || '{"tipo": "LOCAL", "texto": "A' || chr(9) || 'B ' || lang || '"}' || chr(10) || ']' END"""


@query(f"""WITH m AS (SELECT doc_id, nullif(regexp_extract({LISTED}, '(?s)\\[.*\\]'), '') AS o FROM documents), e AS (SELECT doc_id, unnest(from_json(CASE WHEN json_valid(replace(o, chr(9), ' ')) THEN replace(o, chr(9), ' ') ELSE '[]' END, '[{{"texto":"VARCHAR","tipo":"VARCHAR"}}]')) AS e, o FROM m),
    k AS (SELECT doc_id, trim(regexp_replace(lower(e.texto), '\\s+', ' ', 'g')) || ':' || e.tipo AS said, row_number() OVER (PARTITION BY doc_id) AS r FROM e WHERE e.texto IS NOT NULL AND e.tipo IN ('{KNOWN}')),
    f AS (SELECT doc_id, said, min(r) AS r FROM k GROUP BY 1, 2), j AS (SELECT doc_id, string_agg(said, ';' ORDER BY r) AS found FROM f GROUP BY 1)
    SELECT doc_id, coalesce(found, '') AS found FROM documents LEFT JOIN j USING (doc_id)""")
def json_entities(t):
    said = F.replace(F.expr(LISTED), F.lit("\t"), F.lit(" "))
    joined = F.array_join(F.transform(extract.entities(said), lambda e: F.concat(e.getField("texto"), F.lit(":"), e.getField("tipo"))), ";")
    return t.documents.select("doc_id", joined.alias("found"))


def word_sets(t):
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.array_distinct(text.tokens(F.col("text"))).alias("b"))
    return t.benchmark.select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("a")).join(b, "item_id")


PAIRED = "(SELECT x.item_id, list_distinct(regexp_extract_all(lower(x.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(y.text), '[a-z0-9]+')) AS b FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1)"


@query(f"SELECT item_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END, 6) AS jaccard FROM {PAIRED}")
def set_jaccard(t):
    return word_sets(t).select("item_id", F.round(extract.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"SELECT item_id, len(a) - len(list_intersect(a, b)) AS only_said, len(b) - len(list_intersect(a, b)) AS only_gold, len(list_intersect(a, b)) AS both FROM {PAIRED}")
def set_difference_ner(t):
    n = lambda c: F.size(c).cast("long")
    return word_sets(t).select("item_id", n(F.array_except("a", "b")).alias("only_said"), n(F.array_except("b", "a")).alias("only_gold"), n(F.array_intersect("a", "b")).alias("both"))


@query(f"SELECT item_id, list_sort(a) = list_sort(list_reverse(a)[1 + item_id % 2:]) AS same, list_sort(a) = list_sort(b) AS like_next FROM {PAIRED}")
def set_equal_sorted(t):
    """A set of words against itself turned round, of odd items less a word, and against the next."""
    turned = F.slice(F.reverse("a"), 1 + (F.col("item_id") % 2).cast("int"), F.size("a"))
    return word_sets(t).select("item_id", (F.sort_array("a") == F.sort_array(turned)).alias("same"), (F.sort_array("a") == F.sort_array("b")).alias("like_next"))


@query("SELECT conv_id, min(turn) AS turn, text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, text")
def set_dedup_first(t):
    return t.conversations.filter("text is not null").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(lower(text), 1, 80) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1")
def set_dedup_key_prefix(t):
    return t.documents.filter("text is not null").groupBy(F.substring(F.lower("text"), 1, 80).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS p FROM events")
def math_sigmoid(t):
    return t.events.select("event_id", F.round(extract.sigmoid(F.col("value") / 100), 9).alias("p"))


@query("SELECT round(avg(-(y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))), 6) AS bce FROM (SELECT quality AS y, least(n_chars / 2000.0::DOUBLE, 1.0) AS p FROM documents JOIN labels USING (doc_id))")
def math_bce(t):
    scored = t.documents.join(t.labels, "doc_id").select(F.least(F.col("n_chars") / 2000.0, F.lit(1.0)).alias("p"), F.col("quality").alias("y"))
    return scored.agg(F.round(F.avg(extract.cross_entropy(F.col("p"), F.col("y"))), 6).alias("bce"))


@query("SELECT event_id, CAST(format('{:.2e}', value) AS DOUBLE) AS p FROM events WHERE value > 0")
def math_sig3(t):
    return t.events.filter("value > 0").select("event_id", extract.three_digits(F.col("value")).alias("p"))


@query("""SELECT p_partkey, round(1000.0 / s / 3600.0 * u * 5.37, 3) AS marginal, round(u * 24 * 30 * 5.37 / (s * 3600 * 24 * 30 * 0.3 / 1000.0), 3) AS always_on, round(u * 24 * 30 * 5.37, 0) AS month,
    round(s * 1000 / 3600.0 * u * 5.37, 2) AS by_latency, round(s * 1000 / 3600.0 * u * 5.37 / 0.3, 2) AS by_latency_used FROM (SELECT p_partkey, p_retailprice / 1000.0::DOUBLE AS u, p_size::DOUBLE AS s FROM part)""")
def math_cost_model(t):
    u, s = F.col("p_retailprice") / 1000.0, F.col("p_size").cast("double")
    full, used, month = extract.cost_per_thousand(u, s, 5.37, 0.3)
    lat, lat_used = extract.cost_by_latency(u, s, 5.37, 0.3)
    return t.part.select("p_partkey", full.alias("marginal"), used.alias("always_on"), month.alias("month"), lat.alias("by_latency"), lat_used.alias("by_latency_used"))


@query("""WITH c AS (SELECT source, least(count(*) FILTER (quality = 1 AND toxic <> 1), count(*) FILTER (quality <> 1 AND toxic = 1)) AS k, count(*) FILTER (quality = 1 AND toxic <> 1) + count(*) FILTER (quality <> 1 AND toxic = 1) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    s AS (SELECT source, n, k, unnest(range(k + 1)) AS i FROM c)
    SELECT source, n, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) END, 6) AS p FROM s GROUP BY source, n""")
def ev_p_binomial(t):
    x, y = F.col("quality") == 1, F.col("toxic") == 1
    c = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count_if(x & ~y).alias("b10"), F.count_if(~x & y).alias("b01"))
    n = F.col("b10") + F.col("b01")
    return c.select("source", n.alias("n"), F.round(extract.binomial_p(F.least("b10", "b01"), n), 6).alias("p"))


@query()
def ev_p_chi2(t):
    return t.events.select("event_id", F.round(extract.chi2_p(F.abs("value") / 10), 9).alias("p"))


ASKED = "CASE WHEN item_id % 3 = 0 THEN 'Qual a maior praça' WHEN item_id % 3 = 1 THEN 'Volume da praça ' || split_part(text, ' ', 1) || ' em 2020?' ELSE 'Crescimento da praça líder?' END"


@query(f"""WITH q AS (SELECT item_id, {ASKED} AS q FROM benchmark), p AS (SELECT item_id, lower(q) AS low, trim(regexp_extract(q, '{extract.PLACE}', 1)) AS place FROM q),
    n AS (SELECT *, place <> '' AND lower(place) NOT IN ('{"', '".join(extract.NO_PLACE)}') AS named FROM p),
    r AS (SELECT *, ({' OR '.join(f"contains(low, '{w}')" for w in extract.RANKED)}) OR NOT named AS ranking FROM n)
    SELECT item_id, CASE WHEN named THEN place END AS place, ranking, ranking AND ({' OR '.join(f"contains(low, '{w}')" for w in extract.GROWN)}) AS growth FROM r""")
def ag_data_intent(t):
    i, first = F.col("item_id"), F.element_at(F.split("text", " "), 1)
    q = F.when(i % 3 == 0, F.lit("Qual a maior praça")).when(i % 3 == 1, F.concat(F.lit("Volume da praça "), first, F.lit(" em 2020?"))).otherwise(F.lit("Crescimento da praça líder?"))
    return t.benchmark.select("item_id", extract.data_intent(q).alias("d")).select("item_id", "d.*")


CALLS = """html || '<a onclick="LinkTexto(%' || CASE page_id % 3 WHEN 0 THEN 'POR' ELSE 'RES' END || '%,%' || (page_id % 40) || '%,%001%,%2020%,%ANTT%)">x</a> LinkTexto(%RES%,%x%,%1%,%2020%,%A%) LinkTexto(%RES%,%' || (page_id % 7) || '%,%2%,%' || (2000 + page_id % 3) || '%,%%)'"""
CALL = r"LinkTexto\(%([^%]+)%,%(\d+)%,%(\d+)%,%(\d+)%,%([^%]*)%"


def calls_sql() -> str:
    said, call = f"replace({CALLS}, '%', chr(39))".replace("html ||", "replace(html, '%', '') ||"), CALL.replace("%", "''")
    part = lambda i: f"regexp_extract(c, '{call}', {i})"
    return f"""WITH f AS (SELECT page_id, unnest(regexp_extract_all({said}, '{call}')) AS c FROM pages), x AS (SELECT page_id, {part(1)} AS kind, {part(2)} AS num, {part(4)} AS year FROM f)
    SELECT num, year, min(page_id) AS page_id, count(*) AS n FROM x WHERE kind = 'RES' GROUP BY 1, 2"""


@query(calls_sql())
def src_html_links(t):
    """Calls in pages' markup: of either kind, of the kind that is no act, and with a number that is none."""
    said = F.expr(f"replace({CALLS}, '%', chr(39))".replace("html ||", "replace(html, '%', '') ||"))
    found = t.pages.select("page_id", F.explode(extract.link_texts(said)).alias("a")).select("page_id", "a.*")
    return found.groupBy("num", "year").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
