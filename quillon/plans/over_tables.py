"""Queries of detection, tokens, rules and chat over whole given tables, and their SQL.

K is a rule set over words that ``conversations`` holds, with each kind of rule, a phrase among its negators and lemmas; SQL
works its hits out from tokens by joins and windows, where detection uses expressions in the row.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import textnorm as N
from ..operators import chat as C
from ..operators import detect as D
from ..operators import relational as R
from ..operators.language import identified
from ..sources import rules as S
from ..sources import shipped
from ..sources.validation import first_faults
from . import queries as Q
from .queries import FAULTY, GOLDEN, NORM, TOKENS, confidence, query, table, values, verdict_sql

W = N.WHITE_CLASS
K = {
    "language": "en", "version": "1.2.0", "negators": ["for", "in the"], "negation_boundaries": ["and"],
    "intents": [
        {"id": "x", "label": "Ex", "priority": 10, "min_score": 1.0, "examples": [], "rules": [{"type": "keyword", "value": "the", "weight": 1.0}, {"type": "keyword", "value": "with", "weight": 2.0}, {"type": "all", "value": ["that", "this"], "weight": 3.0}, {"type": "pattern", "value": r"of\s+the", "weight": 0.5}]},
        {"id": "y", "label": "Wye", "priority": 20, "min_score": 1.5, "examples": [], "rules": [{"type": "keyword", "value": "that", "weight": 1.5}, {"type": "all", "value": ["from", "was"], "weight": 2.5}, {"type": "lemma", "value": "be", "weight": 1.0}]},
    ],
}
K_JSON = json.dumps(K)
LEMMAS = [("en", "is", "be"), ("en", "was", "be"), ("en", "Are", "be"), ("pt", "era", "ser")]


def k_sets() -> dict[str, S.RuleSet]:
    return {lang: S.rule_set(K_JSON.encode(), lang) for lang in ("pt", "en")}


def said(spark: SparkSession, sf: str) -> DataFrame:
    """msg, text of all turns."""
    return table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("msg"), "text")


def found(spark: SparkSession, sf: str) -> DataFrame:
    """What K says of the turns in a language that is supported."""
    return D.detect_batch(D.spread(said(spark, sf)), sets=k_sets()).where("lang.supported")


SRC = "(SELECT concat_ws('/', conv_id, turn, role) AS doc_id, role AS source, text FROM conversations)"
VERDICT = verdict_sql(SRC)
STRIPPED = f"regexp_replace(coalesce(text, ''), '^[{W}]+|[{W}]+$', '', 'g')"
TILE = D.TILE.replace("'", "''")
TOK = f"""
    m AS (SELECT doc_id AS msg, {STRIPPED} AS stripped FROM {SRC}),
    parts AS (SELECT msg, stripped, unnest(tk) AS p, generate_subscripts(tk, 1) AS j FROM (SELECT msg, stripped, regexp_extract_all(stripped, '{TILE}') AS tk FROM m)),
    off AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY msg ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS o FROM parts),
    tok AS MATERIALIZED (SELECT msg, stripped, (row_number() OVER (PARTITION BY msg ORDER BY j) - 1)::INTEGER AS i, o + (p[1] = ' ')::INTEGER AS idx, CASE WHEN p[1] = ' ' THEN substr(p, 2) ELSE p END AS t FROM off WHERE p <> ' ')"""
RULES = [(k, sum(len(x["rules"]) for x in K["intents"][:k]) + at, f"{i['id']}:{at}", r["type"], v, n, r["weight"]) for k, i in enumerate(K["intents"]) for at, r in enumerate(i["rules"]) for n, v in enumerate(r["value"] if isinstance(r["value"], list) else [r["value"]])]
RULE_SQL = values(RULES, "k, j, id, type, v, ord, w")
INTENT_SQL = values([(k, i["id"], i["label"], i["priority"], float(i["min_score"])) for k, i in enumerate(K["intents"])], "k, intent, label, priority, min_score")


def hits_sql(lemmas: list[tuple] = ()) -> str:
    """CTEs up to hits and ranked, of turns in supported languages."""
    lemma = f"(SELECT coalesce(any_value(l.lemma), t.fold) FROM {values(lemmas, 'lang, word, lemma')[:-len(' AS v(lang, word, lemma)')]} AS l(lang, word, lemma) WHERE l.lang = 'en' AND lower(l.word) = t.fold)" if lemmas else "NULL"
    return f"""{TOK},
    ok AS (SELECT doc_id AS msg, language FROM {VERDICT} WHERE reason = 'ok'),
    tf AS (SELECT tok.*, language, regexp_replace(lower(strip_accents(t)), '[{W}]', ' ', 'g') AS fold, regexp_matches(t, '^[{W}]+$') AND NOT regexp_matches(t, '[\\r\\n]') AS ws, t IN ('.', ',', ';', ':', '!', '?') OR regexp_matches(t, '[\\r\\n]') AS brk FROM tok JOIN ok USING (msg)),
    lex AS (SELECT *, (row_number() OVER (PARTITION BY msg ORDER BY i) - 1)::INTEGER AS pos FROM tf WHERE NOT ws),
    neg AS (SELECT *, fold = 'for' OR (fold = 'the' AND coalesce(lag(fold) OVER (PARTITION BY msg ORDER BY pos) = 'in', false)) AS ends, brk OR fold = 'and' AS bar FROM lex),
    look AS (SELECT *, max(CASE WHEN ends THEN pos END) OVER w AS n, max(CASE WHEN bar THEN pos END) OVER w AS b FROM neg WINDOW w AS (PARTITION BY msg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    tk AS MATERIALIZED (SELECT t.*, coalesce(pos - n <= 3 AND (b IS NULL OR b <= n), false) AS negated, {lemma} AS lemma FROM look t),
    allv AS (SELECT * FROM {RULE_SQL} WHERE type = 'all'),
    sat AS (SELECT msg, k, j FROM tk JOIN allv ON fold = v GROUP BY msg, k, j HAVING count(DISTINCT v) = 2),
    used AS (SELECT DISTINCT msg, k, v AS fold FROM sat JOIN allv USING (k, j)),
    wt AS (SELECT *, lead(fold) OVER z AS f2, lead(i) OVER z AS i2, lead(idx) OVER z AS x2 FROM tk WHERE regexp_matches(fold, '[\\p{{L}}\\p{{N}}]') WINDOW z AS (PARTITION BY msg ORDER BY i)),
    hits AS MATERIALIZED (
        SELECT msg, k, j, any_value(id) AS id, 'all' AS type, v AS shown, any_value(w) AS w, arg_min(idx, i) AS s, arg_min(idx + length(t), i) AS e, arg_min(t, i) AS text, min(i) AS i0, min(i) AS i1, arg_min(negated, i) AS negated, 0 AS kind, any_value(ord) AS ord
        FROM tk JOIN allv ON fold = v SEMI JOIN sat USING (msg, k, j) GROUP BY msg, k, j, v
        UNION ALL
        SELECT msg, k, j, id, type, v, w, idx, idx + length(t), t, i, i, negated, 1, i FROM tk JOIN {RULE_SQL} ON v = CASE WHEN type = 'lemma' THEN lemma ELSE fold END AND type IN ('keyword', 'lemma')
        WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.msg = tk.msg AND u.k = v.k AND u.fold = tk.fold)
        UNION ALL
        SELECT msg, k, j, id, type, v, w, idx, x2 + 3, substr(stripped, idx + 1, x2 + 3 - idx), i, i2, negated, 2, i FROM wt JOIN {RULE_SQL} ON type = 'pattern' WHERE fold = 'of' AND f2 = 'the'),
    ruled AS (SELECT msg, k, j, any_value(id) AS id, any_value(w) AS w, CASE WHEN any_value(type) = 'all' THEN bool_and(NOT negated) ELSE bool_or(NOT negated) END AS credited, count(*) AS n_hits, count(*) FILTER (negated) AS n_negated FROM hits GROUP BY msg, k, j),
    scored AS (SELECT msg, k, coalesce(sum(w) FILTER (credited), 0)::DOUBLE AS score FROM ruled GROUP BY msg, k),
    fitted AS (SELECT *, score > 0 AND score >= min_score AS fit, round(score / (score + 1), 4) AS conf FROM scored JOIN {INTENT_SQL} USING (k)),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY fit DESC, score DESC, priority DESC, intent) AS rnk FROM fitted),
    best AS MATERIALIZED (SELECT ok.msg, language, intent, label, k, coalesce(intent, 'desconhecido') AS prim, coalesce(conf, 0) AS conf FROM ok LEFT JOIN (SELECT * FROM ranked WHERE fit AND rnk = 1) USING (msg))"""


HITS = hits_sql()


@query(f"WITH {TOK} SELECT msg, i, idx, t AS text FROM tok")
def tokenise(spark, sf):
    rows = said(spark, sf).select("msg", N.stripped_text(F.coalesce("text", F.lit(""))).alias("text"))
    return D.tokenised(rows, "text").select("msg", F.explode("tok").alias("t")).select("msg", "t.i", "t.idx", "t.text")


@query(f"""
    WITH c AS (SELECT doc_id AS msg, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM {SRC} WHERE text <> ''),
    f AS (SELECT msg, i, regexp_replace(lower(strip_accents(c)), '[{W}]', ' ', 'g') AS f FROM c),
    o AS (SELECT *, lag(f) OVER (PARTITION BY msg ORDER BY i) AS p FROM f WHERE f <> ''),
    u AS (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY i) AS r, count(*) OVER (PARTITION BY msg) AS n FROM o WHERE NOT (f = ' ' AND p IS NOT DISTINCT FROM ' '))
    SELECT msg, string_agg(f, '' ORDER BY i) AS normalised, md5(string_agg(i, ',' ORDER BY i)) AS index_map FROM u WHERE NOT (f = ' ' AND r IN (1, n)) GROUP BY msg""")
def normalise_index_map(spark, sf):
    map_ = N.index_map(F.col("text"))
    return said(spark, sf).where(F.size(map_) > 0).select("msg", N.normalise(F.col("text")).alias("normalised"), F.md5(F.array_join(map_.cast("array<string>"), ",")).alias("index_map"))


EDGE = "[^\\p{L}\\p{N}_]"


@query(f"SELECT doc_id AS msg, regexp_matches({NORM}, '(^|{EDGE})(la|the)($|{EDGE})') AS hit FROM {SRC}")
def pattern_word_boundary(spark, sf):
    return said(spark, sf).select("msg", N.normalise(F.coalesce("text", F.lit(""))).rlike(S.java_pattern("(la|the)")).alias("hit"))


GATED = f"(SELECT doc_id AS msg, CASE WHEN n = 0 THEN 'empty' WHEN n < 2 THEN 'too_short' WHEN n > 5000 THEN 'too_long' END AS gate, CASE WHEN n < 2 OR n > 5000 THEN 'empty_text' ELSE reason END AS reason, CASE WHEN n BETWEEN 2 AND 5000 THEN script END AS script FROM {VERDICT} JOIN (SELECT doc_id, length({STRIPPED}) AS n FROM {SRC}) USING (doc_id))"


@query(f"SELECT msg, gate AS error_code, reason, script FROM {GATED}")
def detect_unsupported(spark, sf):
    return D.detect(D.spread(said(spark, sf))).select("msg", "error_code", "lang.reason", "lang.script")


@query(f"SELECT msg, CASE WHEN gate IS NOT NULL THEN gate WHEN reason <> 'ok' THEN 'unsupported_language' END AS error_code FROM {GATED}")
def require_supported(spark, sf):
    return D.detect(D.spread(said(spark, sf)), require_supported=True).select("msg", "error_code")


@query(f"SELECT msg, CASE reason WHEN 'unsupported_script' THEN 'Idioma não suportado (escrita ' || script || ').' {' '.join(f'WHEN {Q.q(r)} THEN {Q.q(t)}' for r, t in D.EXPLAIN_UNSUPPORTED.items())} END AS explanation FROM {GATED} WHERE reason <> 'ok'")
def explain_unsupported(spark, sf):
    return D.detect(D.spread(said(spark, sf))).where("NOT lang.supported").select("msg", "explanation")


SAID = "coalesce(string_agg(type || ' ''' || shown || '''', ', ' ORDER BY kind, j, ord), 'nenhuma regra')"
EXPLAINED = f"(SELECT best.msg, CASE WHEN any_value(intent) IS NULL THEN 'Nenhum intento identificado com confiança suficiente.' ELSE 'Mensagem classificada como ' || any_value(label) || ' (regras: ' || {SAID} || ').' END AS explanation FROM best LEFT JOIN (SELECT * FROM hits WHERE NOT negated) h ON h.msg = best.msg AND h.k = best.k GROUP BY best.msg)"


@query(f"WITH {HITS} SELECT * FROM {EXPLAINED}")
def explanation(spark, sf):
    return found(spark, sf).select("msg", "explanation")


@query(f"WITH {HITS} SELECT msg, id AS rule_id, s AS char_start, e AS char_end, text AS matched_text, true AS offsets_exact, negated FROM hits")
def rule_trace(spark, sf):
    return found(spark, sf).select("msg", F.explode("trace").alias("h")).select("msg", F.col("h.id").alias("rule_id"), F.col("h.s").alias("char_start"), F.col("h.e").alias("char_end"), F.col("h.text").alias("matched_text"), F.col("h.exact").alias("offsets_exact"), "h.negated")


def traced(spark, sf):
    both = F.expr("concat(kept, dropped)")
    rows = found(spark, sf).select("msg", F.explode(both).alias("x"), "trace").select("msg", "x.intent", "x.k", "x.score", F.explode("trace").alias("h"))
    return rows.where("h.k = k")


@query(f"WITH {HITS} SELECT msg, id AS rule_id, count(DISTINCT (s, e)) AS n_hits, any_value(score) AS score FROM hits JOIN scored USING (msg, k) GROUP BY msg, id")
def hit_dedup(spark, sf):
    """A rule that hits again and again counts once, and no place is hit twice by a rule."""
    return traced(spark, sf).groupBy("msg", F.col("h.id").alias("rule_id")).agg(F.count("*").alias("n_hits"), F.max("score").alias("score"))


@query(f"WITH {HITS} SELECT msg, intent, score, id AS rule_id, n_hits, n_negated FROM ruled JOIN fitted USING (msg, k)")
def negation_semantics(spark, sf):
    """A rule counts if one of its hits is not negated, an ``all`` rule only if none of its parts is: told by the scores."""
    return traced(spark, sf).groupBy("msg", "intent", "score", F.col("h.id").alias("rule_id")).agg(F.count("*").alias("n_hits"), F.count_if("h.negated").alias("n_negated"))


MARKS = "(SELECT DISTINCT h.msg, h.negated, unnest(range(h.i0, h.i1 + 1)) AS i FROM hits h JOIN best ON best.msg = h.msg WHERE best.intent IS NULL OR EXISTS (SELECT 1 FROM ranked r WHERE r.msg = h.msg AND r.k = h.k AND fit))"


@query(f"WITH {HITS} SELECT msg, count(*) FILTER (NOT negated) AS n_matched, coalesce(sum(i) FILTER (NOT negated), 0)::BIGINT AS matched, count(*) FILTER (negated) AS n_negated, coalesce(sum(i) FILTER (negated), 0)::BIGINT AS negated FROM {MARKS} GROUP BY msg")
def token_marks(spark, sf):
    total = lambda c: F.expr(f"aggregate({c}, 0L, (a, x) -> a + x)")
    return found(spark, sf).where("size(matched) + size(negated) > 0").select("msg", F.size("matched").cast("long").alias("n_matched"), total("matched").alias("matched"), F.size("negated").cast("long").alias("n_negated"), total("negated").alias("negated"))


@query(f"WITH {HITS} SELECT msg, string_agg(pos, ',' ORDER BY pos) AS ends FROM neg WHERE ends GROUP BY msg")
def negator_ends(spark, sf):
    return found(spark, sf).where("size(neg) > 0").select("msg", F.array_join(F.col("neg").cast("array<string>"), ",").alias("ends"))


def stop_words() -> list[tuple[str, str]]:
    """Spark's own lists, as a file beside this one: no Spark need be installed, or run, to import the SQL."""
    lists = json.loads(Path(__file__).with_name("stop_words.json").read_text("utf-8"))
    return sorted({(lang, w) for lang in D.STOP_LISTS for w in D.folded(lists[lang])})


ENDER = "(t IN ('.', '!', '?') OR regexp_matches(t, '[\\r\\n]'))"


@query(f"""WITH {HITS},
    starts AS (SELECT msg, i, NOT {ENDER} AND coalesce(lag({ENDER}) OVER (PARTITION BY msg ORDER BY pos), true) AS is_sentence_start FROM lex)
    SELECT tf.msg, tf.i, t AS text, (language, fold) IN (SELECT (lang, word) FROM {values(stop_words(), 'lang, word')}) AS is_stop, coalesce(is_sentence_start, false) AS is_sentence_start,
        EXISTS (SELECT 1 FROM {MARKS} x WHERE x.msg = tf.msg AND x.i = tf.i AND NOT x.negated) AS matched, EXISTS (SELECT 1 FROM {MARKS} x WHERE x.msg = tf.msg AND x.i = tf.i AND x.negated) AS negated
    FROM tf LEFT JOIN starts USING (msg, i)""")
def token_table(spark, sf):
    return D.token_view(found(spark, sf)).select("msg", "i", "text", "is_stop", "is_sentence_start", "matched", "negated")


VIEW = "{'intent': intent, 'label': label, 'score': score, 'confidence': conf, 'priority': priority, 'min_score': min_score}"
RESOURCES = json.dumps([{"language": lang, "version": K["version"], "entries": len(K["intents"]), "sha256": "#", "limitations": [f"rules on lemmas are skipped for {lang}"]} for lang in ("pt", "en")], separators=(",", ":"))


@query(f"""WITH {HITS},
    v AS (SELECT msg, to_json(coalesce(list({VIEW} ORDER BY rnk) FILTER (fit), [])) AS kept, to_json(coalesce(list({VIEW} ORDER BY score DESC, priority DESC, intent) FILTER (NOT fit), [])) AS dropped, count(*) FILTER (fit) AS n FROM ranked GROUP BY msg)
    SELECT best.msg, '{{"language":' || to_json(language) || ',"language_reason":"ok","primary":' || to_json(prim) || ',"confidence":' || to_json(conf::DOUBLE) || ',"multi_intent":' || (coalesce(n, 0) > 1) || ',"rank_reason":"ok","intents":' || coalesce(kept, '[]') || ',"dropped":' || coalesce(dropped, '[]') || ',"rules_version":"{K["version"]}","resources":' || replace('{RESOURCES}', '#', sha256({Q.q(K_JSON)})) || ',"explanation":' || to_json(explanation) || '}}' AS result
    FROM best JOIN {EXPLAINED} x ON x.msg = best.msg LEFT JOIN v ON v.msg = best.msg""")
def result_json(spark, sf):
    return D.resulted(found(spark, sf), k_sets()).select("msg", "result")


@query(f"WITH {HITS} SELECT msg, string_agg(DISTINCT id, ',' ORDER BY id) AS rules FROM hits GROUP BY msg")
def lemma_skipped(spark, sf):
    """Without lemmas, rules on them are skipped and all others hit."""
    return found(spark, sf).where("size(trace) > 0").select("msg", F.array_join(F.expr("array_sort(array_distinct(transform(trace, h -> h.id)))"), ",").alias("rules"))


@query(f"WITH {hits_sql(LEMMAS)} SELECT msg, id AS rule_id, count(*) AS n_hits, count(*) FILTER (negated) AS n_negated FROM hits GROUP BY msg, id")
def lemma_hits(spark, sf):
    """Lemmas from a dictionary, looked up once for each distinct word of all messages."""
    dictionary = spark.createDataFrame(LEMMAS, "language string, word string, lemma string")
    rows = R.with_lemmas(said(spark, sf), dictionary, "en", "msg")
    hits = D.detect_batch(D.spread(rows), sets=k_sets(), lemmas="lemmas").select("msg", F.explode("trace").alias("h"))
    return hits.groupBy("msg", F.col("h.id").alias("rule_id")).agg(F.count("*").alias("n_hits"), F.count_if("h.negated").alias("n_negated"))


DOC_NEG = f"(SELECT doc_id, win, pos, max(CASE WHEN ends THEN pos END) OVER w AS n, max(CASE WHEN token IN ('and', '.', ',') THEN pos END) OVER w AS b FROM (SELECT *, token = 'for' OR (token = 'the' AND coalesce(lag(token) OVER (PARTITION BY doc_id ORDER BY pos) = 'in', false)) AS ends FROM {TOKENS}), (SELECT unnest([0, 1, 3, 5]) AS win) WINDOW w AS (PARTITION BY doc_id, win ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"SELECT doc_id, win, count(*) AS n_negated, sum(pos)::BIGINT AS places FROM {DOC_NEG} WHERE pos - n <= win AND (b IS NULL OR b <= n) GROUP BY doc_id, win")
def negation_windows(spark, sf):
    """Phrases and words as negators, over documents, with windows of four sizes."""
    tokens, out = R.tokens(table(spark, sf, "documents"), "doc_id"), None
    for win in (0, 1, 3, 5):
        part = R.negated(tokens, "doc_id", K["negators"], ["and", ".", ","], win).where("negated").select("doc_id", F.lit(win).alias("win"), "pos")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("doc_id", "win").agg(F.count("*").alias("n_negated"), F.sum("pos").alias("places"))


NORM_TILES = f"(SELECT doc_id, j, p, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS o FROM (SELECT doc_id, unnest(tk) AS p, generate_subscripts(tk, 1) AS j FROM (SELECT doc_id, regexp_extract_all({NORM}, '{TILE}') AS tk FROM documents)))"


@query(f"""
    WITH t AS MATERIALIZED (SELECT * FROM {NORM_TILES} WHERE p <> ' '),
    n AS (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY j) AS p2, lead(o) OVER (PARTITION BY doc_id ORDER BY j) AS o2 FROM t),
    s AS (SELECT doc_id, o + length(p) - 2 AS s, o2 + 3 AS e FROM n WHERE regexp_matches(p, '^(.*'')?of$') AND regexp_matches(p2, '^the(''.*)?$') AND o2 = o + length(p) + 1)
    SELECT s.doc_id, s.s, s.e, count(*) AS n_tokens, min(t.o) AS first_token FROM s JOIN t ON t.doc_id = s.doc_id AND t.o < s.e AND t.o + length(t.p) > s.s GROUP BY s.doc_id, s.s, s.e""")
def span_tokens(spark, sf):
    """Which tokens each span of a pattern covers, and where the first begins: a bucketed join of intervals."""
    rows = D.spread(table(spark, sf, "documents").select("doc_id", N.normalise(F.coalesce("text", F.lit(""))).alias("t")))
    marked = rows.select("doc_id", F.regexp_replace(F.translate("t", D.OPEN + D.CLOSE, D.OTHER + D.OTHER), S.java_pattern(Q.K_PATTERN), D.MARKED).alias("m"))
    spans = marked.where(F.contains("m", F.lit(D.OPEN))).select("doc_id", F.explode(F.expr(D.spans("m"))).alias("z")).select("doc_id", F.col("z.s").alias("s"), (F.col("z.s") + F.col("z.n")).alias("e"))
    tokens = D.tokenised(rows, "t").select("doc_id", F.explode("tok").alias("k")).select("doc_id", F.col("k.i").alias("i"), F.col("k.idx").alias("begin"), (F.col("k.idx") + F.length("k.text")).alias("end"))
    return R.overlapping(spans, tokens, "doc_id").groupBy("doc_id", "s", "e").agg(F.count("*").alias("n_tokens"), F.min("begin").alias("first_token"))


COUNTED = f"(SELECT word, count(*) AS n FROM (SELECT unnest({Q.WORDS}) AS word FROM conversations) GROUP BY word)"
LANGUAGES = f"(SELECT language, count(*) AS n_messages FROM {VERDICT} WHERE language IS NOT NULL GROUP BY language)"


def counted(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").select(F.explode(N.letter_words(N.normalise(F.coalesce("text", F.lit(""))))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def with_messages(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """``rows`` by language and how many turns are in it."""
    of = identified(said(spark, sf)).groupBy(F.col("lang.language").alias("language")).agg(F.count("*").alias("n_messages"))
    return rows.join(of, "language", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0).cast("long")))


SHIPPED = tuple(map(S.shipped_rules, ("pt", "en")))
OF_RULES = [(lang, name, label, p, float(m), f"{name}:{j}", t, ",".join(v if isinstance(v, list) else [v]), v[0] if isinstance(v, list) else v, w) for lang, name, label, p, m, rules in shipped.INTENTS for j, (t, v, w) in enumerate(rules)]
OF_RULES_SQL = f"(SELECT v.*, coalesce(c.n, 0) AS n FROM {values(OF_RULES, 'language, intent_id, label, priority, min_score, rule_id, type, value, first, weight')} LEFT JOIN {COUNTED} c ON c.word = v.first AND type <> 'pattern')"


def rules_counted(spark: SparkSession, sf: str) -> DataFrame:
    """The rules and how often the turns hold their first word."""
    rules = S.rules_table(spark, *SHIPPED).withColumn("word", F.when(F.col("type") != "pattern", F.element_at("value", 1)))
    return rules.join(counted(spark, sf), "word", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(f"SELECT language, intent_id, rule_id, type, value, weight, n FROM {OF_RULES_SQL}")
def rules_flatten(spark, sf):
    return rules_counted(spark, sf).select("language", "intent_id", "rule_id", "type", F.array_join("value", ",").alias("value"), "weight", "n")


@query(f"SELECT language, intent_id, label, priority, min_score, count(*) AS rule_count, sum(n)::BIGINT AS n FROM {OF_RULES_SQL} GROUP BY ALL")
def rules_catalogue(spark, sf):
    counts = rules_counted(spark, sf).groupBy("language", "intent_id").agg(F.sum("n").alias("n"))
    return S.catalogue(S.rules_table(spark, *SHIPPED)).join(counts, ["language", "intent_id"])


@query(f"SELECT language, kind, v.word, coalesce(n, 0) AS n FROM {values([(lang, w, k) for k, words in (('exclusive', shipped.EXCLUSIVE), ('shared', shipped.SHARED)) for lang in ('pt', 'en') for w in words[lang]], 'language, word, kind')} LEFT JOIN {COUNTED} c ON c.word = v.word")
def markers_flatten(spark, sf):
    return S.markers_table(spark, ("pt", "en")).join(counted(spark, sf), "word", "left").select("language", "kind", "word", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"SELECT v.*, coalesce(n_messages, 0) AS n_messages FROM {values(Q.DUMPED, 'language, intent_id, label, priority, min_score, rules, negators, boundaries')} LEFT JOIN {LANGUAGES} USING (language)")
def rules_dump(spark, sf):
    return with_messages(spark, sf, Q.CASES["rules_dump"](spark, sf))


@query(f"SELECT language, sha256(content) AS sha256, coalesce(n_messages, 0) AS n_messages FROM {values([(lang, json.dumps(S.shipped_document(lang), ensure_ascii=False)) for lang in ('pt', 'en')], 'language, content')} LEFT JOIN {LANGUAGES} USING (language)")
def rules_digest(spark, sf):
    return with_messages(spark, sf, S.dump(spark, *SHIPPED).select("language", "sha256"))


HEALTH_SQL = values(Q.HEALTH, "language, lemmas, version, entries, doc, tokeniser, limitations")


@query(f"SELECT language, version, entries, limitations, coalesce(n_messages, 0) AS n_messages FROM {HEALTH_SQL} LEFT JOIN {LANGUAGES} USING (language) WHERE NOT lemmas")
def resource_report(spark, sf):
    return with_messages(spark, sf, Q.CASES["resource_report"](spark, sf))


@query(f"SELECT language, lemmas, version, entries, sha256(doc) AS sha256, tokeniser, limitations, coalesce(n_messages, 0) AS n_messages FROM {HEALTH_SQL} LEFT JOIN {LANGUAGES} USING (language)")
def health(spark, sf):
    return with_messages(spark, sf, Q.CASES["health"](spark, sf))


#: Rule documents made of each part's name: a good one and one with each fault, by the part's key.
TEMPLATES = [Q.faulty(change).replace('"cancelar"', '"@"', 1) if change not in ({"intents.1.id": "cancelar"},) else Q.faulty(change) for change, _ in FAULTY]
NAMED = "lower(regexp_extract(p_name, '[A-Za-z]+', 0))"


@query(f"SELECT p_partkey, ({'[' + ', '.join(Q.q(p) if p is not None else 'NULL' for _, p in FAULTY) + ']'})[p_partkey % {len(FAULTY)} + 1] AS first_fault FROM part")
def rules_violations(spark, sf):
    """Each part's name in a rule document, with one of all faults or none, checked as relations."""
    document = F.get(F.array(*map(F.lit, TEMPLATES)), F.pmod("p_partkey", F.lit(len(TEMPLATES))).cast("int"))
    docs = table(spark, sf, "part").select("p_partkey", F.replace(document, F.lit("@"), F.concat(F.lower(F.regexp_extract("p_name", "[A-Za-z]+", 0)), F.lit("_x"))).alias("doc"))
    return first_faults(D.spread(docs), "p_partkey")


#: Sessions of users, whose events say the ten messages in turn.
PRIMS, CONFS = [g[1][0][0] if g[1] else "desconhecido" for g in GOLDEN], [confidence(g[1][0][1]) if g[1] else 0.0 for g in GOLDEN]
FOLDED = Q.FOLDED.replace(f"[{', '.join(map(Q.q, Q.SCRIPT))}][event_id % {len(Q.SCRIPT)} + 1] AS prim", f"[{', '.join(map(Q.q, PRIMS))}][event_id % 10 + 1] AS prim").replace("CASE WHEN event_id % 3 = 0 THEN 0.2 ELSE 0.8 END AS conf", f"{CONFS}[event_id % 10 + 1] AS conf")


def user_sessions(spark, sf):
    rows = table(spark, sf, "events").where("user_id IS NOT NULL")
    text = F.get(F.array(*(F.lit(g[0]) for g in GOLDEN)), F.pmod("event_id", F.lit(10)).cast("int"))
    return rows.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("int").alias("turn"), text.alias("text"))


@query(f"SELECT session_id, turn, turn_index, strategy, pending_step FROM {FOLDED}")
def chat_turns(spark, sf):
    return C.chat(user_sessions(spark, sf)).select("session_id", "turn", "turn_index", "strategy", "pending_step")


@query(f"SELECT session_id, turn, strategy, CASE WHEN said IS NOT NULL THEN replace(said, '#', {Q.PROTOCOL}::VARCHAR) ELSE {Q.DIRECT} END AS reply FROM (SELECT *, strategy AS intent, [{', '.join(Q.q(g[0]) for g in GOLDEN)}][turn % 10 + 1] AS text FROM {FOLDED})")
def chat_replies(spark, sf):
    return C.chat(user_sessions(spark, sf)).select("session_id", "turn", "strategy", "reply")


@query(f"SELECT session_id, (turn_index + (v.role = 'bot')::INTEGER)::INTEGER AS turn_index, v.role, strategy FROM {FOLDED}, {values([('user',), ('bot',)], 'role')}")
def history_log(spark, sf):
    return C.log_rows(C.chat(user_sessions(spark, sf)), F.to_timestamp(F.lit("2024-01-01 00:00:00"))).select("session_id", "turn_index", "role", "strategy")
