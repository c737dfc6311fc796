from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks import segments as seg, stats as st, timeseries as ts
from checks.fixtures import over
from checks.quality import c as dirty
from checks.registry import query
from tabulight.functions import vocab
from tabulight.operators import questions
from tabulight.plans.profile import union_all

TYPES = {"o_orderkey": "NUM", "o_custkey": "NUM", "o_orderstatus": "TEXT", "o_totalprice": "NUM", "o_orderdate": "DATE",
         "o_orderpriority": "TEXT"}
WORDS = {**vocab.NUMBER_WORDS, **vocab.SYNONYMS}
MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in WORDS.items()) + "}"


def norm(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g')"
    phrased = plain
    for phrase, word in vocab.SYNONYMS.items():
        if " " in phrase:
            phrased = f"regexp_replace({phrased}, '\\b{phrase}\\b', '{word}', 'g')"
    tokens = f"list_filter(string_split_regex({phrased}, '\\s+'), lambda t: t <> '')"
    return f"array_to_string(list_transform({tokens}, lambda t: coalesce(map_extract_value({MAP}, t), t)), ' ')"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PLACES = dict(zip("abcd", vocab.INTENTS))
INTENT = f"CASE greatest({', '.join(PLACES)}) WHEN 0 THEN 'UNKNOWN' " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in PLACES.items()) + " END"
HITS = ", ".join(f"len(list_intersect(string_split(n, ' '), {listed(vocab.INTENTS[name])})) AS {k}" for k, name in PLACES.items())
STOPS = listed(vocab.STOP_WORDS)
NORMAL = f", q AS (SELECT conv_id, turn, text, {norm('text')} AS n FROM questions), k AS (SELECT *, {HITS} FROM q)"
TERMS = f", q AS (SELECT conv_id, turn, {norm('text')} AS n FROM questions), w AS (SELECT conv_id, turn, unnest(regexp_extract_all(n, '[a-z0-9]+')) AS term FROM q), " \
        f"f AS (SELECT conv_id, turn, term, count(*) AS k FROM w WHERE len(term) > 1 AND NOT list_contains({STOPS}, term) GROUP BY ALL)"


def qs(sql: str) -> str:
    return over("questions", sql)


@query("j01_normalize_questions", qs(f"SELECT conv_id, turn, text, {norm('text')} AS normalized FROM questions"))
def _(t):
    return questions.normalize_questions(t.questions)


@query("j02_detect_intent", qs(NORMAL + f" SELECT conv_id, turn, {INTENT} AS intent FROM k"))
def _(t):
    return questions.detect_intent(t.questions).drop("text")


def contains_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


FAST = f"""
    SELECT conv_id, turn, CASE WHEN {contains_any(vocab.CHART_PHRASES)} THEN 'query' WHEN {contains_any(vocab.SCHEMA_PHRASES)} THEN 'schema'
        WHEN {contains_any(vocab.QUERY_PHRASES)} THEN 'query' END AS fast_intent
    FROM (SELECT *, lower(trim(text)) AS q FROM questions)"""


@query("j03_fast_intent", qs(FAST))
def _(t):
    return questions.fast_intent(t.questions).drop("text")


@query("j04_tf_vectors", qs(TERMS + """
    SELECT conv_id, turn, term, round(k / sum(k) OVER (PARTITION BY conv_id, turn), 8) AS tf FROM f"""))
def _(t):
    return questions.tf_vectors(t.questions, ["conv_id", "turn"]).withColumn("tf", F.round("tf", 8))


NAME_WORDS = [w for c in TYPES for w in c.split("_")]
SCHEMA = " ".join(f"{c} {kind}" for c, kind in TYPES.items())
CONTEXT = " ".join([*NAME_WORDS * 5, SCHEMA, *vocab.CONTEXT_WORDS])


def weights(name: str, text: str) -> str:
    return f""", {name} AS (SELECT term, count(*) AS k FROM (SELECT unnest(regexp_extract_all(lower('{text}'), '[a-z0-9]+')) AS term)
                 WHERE len(term) > 1 AND NOT list_contains({STOPS}, term) GROUP BY 1)"""


def cos(name: str) -> str:
    return f"""(SELECT f.conv_id, f.turn, coalesce(sum(f.k * c.k), 0) / sqrt(sum(f.k * f.k)) / (SELECT sqrt(sum(k * k)) FROM {name}) AS cosine
                FROM f LEFT JOIN {name} c ON f.term = c.term GROUP BY 1, 2)"""


@query("j05_cosine_to_context", qs(TERMS + weights("ctx", CONTEXT) + f"""
    SELECT q.conv_id, q.turn, round(coalesce(cosine, 0), 8) AS cosine FROM q LEFT JOIN {cos('ctx')} s ON q.conv_id = s.conv_id AND q.turn = s.turn"""))
def _(t):
    return questions.cosine_to_context(t.questions, TYPES).select("conv_id", "turn", F.round("cosine", 8).alias("cosine"))


NAMES = listed(list(dict.fromkeys(NAME_WORDS)))
OVERLAP = f"""len(list_intersect(list_distinct(regexp_extract_all(n, '[a-z0-9]+')), {NAMES})) / greatest(1, len(list_distinct(regexp_extract_all(n, '[a-z0-9]+'))))"""


@query("j06_entity_overlap", qs(NORMAL + f" SELECT conv_id, turn, round({OVERLAP}, 8) AS entity_overlap FROM q"))
def _(t):
    return questions.entity_overlap(t.questions, TYPES).select("conv_id", "turn", F.round("entity_overlap", 8).alias("entity_overlap"))


def worded(patterns: list[str]) -> str:
    """The patterns with word borders of all alphabets, which this regex engine knows for ASCII only."""
    inner = [p.removeprefix(r"\b").removesuffix(r"\b").replace(r"\w", r"[\p{L}\p{N}_]") for p in patterns]
    return "'(^|[^\\p{L}\\p{N}_])(" + "|".join(inner) + ")($|[^\\p{L}\\p{N}_])'"


ON_TOPIC, OFF_TOPIC = worded(vocab.DATASET_PATTERNS), worded(vocab.OFF_TOPIC_PATTERNS)
FOLLOW = ", ".join(f"'{w}'" for w in vocab.FOLLOW_UPS)


@query("j07_score_relevance", qs(TERMS + weights("ctx", CONTEXT) + weights("sch", SCHEMA) + f""",
    k AS (SELECT *, {HITS} FROM q), r AS (SELECT *, {INTENT} AS intent FROM k),
    s AS (SELECT r.*, 0.4 * CAST(intent <> 'UNKNOWN' AS INTEGER) + 0.3 * coalesce(x.cosine, 0) + 0.2 * least(1, 3 * coalesce(y.cosine, 0)) + 0.1 * ({OVERLAP}) AS hybrid
          FROM r LEFT JOIN {cos('ctx')} x ON r.conv_id = x.conv_id AND r.turn = x.turn LEFT JOIN {cos('sch')} y ON r.conv_id = y.conv_id AND r.turn = y.turn),
    z AS (SELECT *, CASE WHEN n IN ({FOLLOW}) OR (len(list_filter(string_split(n, ' '), lambda w: w <> '')) <= 2 AND intent <> 'UNKNOWN') THEN 'follow-up'
                         WHEN intent = 'SHOW_DATA' THEN 'show data' WHEN regexp_matches(n, {ON_TOPIC}) THEN 'data pattern'
                         WHEN intent = 'UNKNOWN' AND regexp_matches(n, {OFF_TOPIC}) THEN 'off topic' ELSE 'score' END AS rule FROM s)
    SELECT conv_id, turn, intent, rule, round(CASE rule WHEN 'score' THEN hybrid WHEN 'off topic' THEN 0 ELSE 1 END, 8) AS score,
           CASE WHEN rule = 'off topic' OR (rule = 'score' AND hybrid < 0.2) THEN 'reject' WHEN rule = 'score' AND hybrid < 0.6 THEN 'uncertain' ELSE 'accept' END AS decision
    FROM z"""))
def _(t):
    return questions.score_relevance(t.questions, TYPES).select("conv_id", "turn", "intent", "rule", F.round("score", 8).alias("score"), "decision")


def routed(code: str, words: list[str]) -> str:
    then = f"CASE WHEN {contains_any(vocab.PLAIN_ROW_PHRASES)} THEN 'head' ELSE 'top' END" if code == "rows" else f"'{code}'"
    return f"WHEN {contains_any(words)} THEN {then}"


@query("j08_route_question", qs(f"""
    SELECT conv_id, turn, CASE {" ".join(routed(code, words) for code, words in vocab.ROUTES.items())}
        WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: len(w) > 2)) > 0 THEN 'search' ELSE 'preview' END AS op_code,
        coalesce(TRY_CAST(regexp_extract(q, 'top\\s*(\\d+)', 1) AS INTEGER), 10) AS n
    FROM (SELECT *, lower(trim(text)) AS q FROM questions)"""))
def _(t):
    return questions.route_question(t.questions).drop("text")


@query("j08_answer", dirty("""
    SELECT 'average' AS question, "column" AS a, CAST(b AS VARCHAR) AS b FROM (
      SELECT 'c_custkey' AS "column", CAST(round(avg(c_custkey), 2) AS DECIMAL(18,2)) AS b FROM dirty_customer UNION ALL
      SELECT 'acctbal', CAST(round(avg(acctbal), 2) AS DECIMAL(18,2)) FROM dirty_customer UNION ALL
      SELECT 'mostly_zero', CAST(round(avg(mostly_zero), 2) AS DECIMAL(18,2)) FROM dirty_customer UNION ALL
      SELECT 'c_nationkey', CAST(round(avg(c_nationkey), 2) AS DECIMAL(18,2)) FROM dirty_customer)
    UNION ALL SELECT 'count', NULL, CAST(count(*) AS VARCHAR) FROM dirty_customer
    UNION ALL SELECT 'distinct', active_flag, NULL FROM dirty_customer GROUP BY active_flag
    UNION ALL SELECT * FROM (SELECT 'lowest', active_flag, CAST(c_custkey AS VARCHAR) FROM (SELECT * FROM dirty_customer ORDER BY c_custkey LIMIT 10))"""))
def _(t):
    from checks.quality import TYPES as types

    df = t.dirty_customer
    ask = lambda q: questions.answer(df, q, ["c_custkey"], types)
    row = lambda frame, name, a, b: frame.select(F.lit(name).alias("question"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    return union_all([
        row(ask("average values"), "average", F.col("column"), F.col("average").cast("decimal(18,2)")),
        row(ask("How many are there?"), "count", F.lit(None), F.col("total_rows")),
        row(ask("unique active_flag"), "distinct", F.col("active_flag"), F.lit(None)),
        row(questions.answer(df, "lowest", ["c_custkey"], types), "lowest", F.col("active_flag"), F.col("c_custkey")),
    ])


PRICE_NUMBERS, PRICE_TEXTS = ["order_no", "price", "refund"], ["status", "priority", "clerk"]


@query("j09_suggest_questions", over("busy_orders", f"""
    SELECT CAST(row_number() OVER (ORDER BY r, question) AS INTEGER) AS seq, about, question FROM (
      SELECT 1 AS r, 'missing' AS about, 'Which rows have no price?' AS question FROM busy_orders HAVING count(*) > count(price) UNION ALL
      SELECT 2, 'segments', 'Why is price higher for ' || best_segment || ' than for ' || worst_segment || ' in ' || "column" || '?'
        FROM ({" UNION ALL ".join(seg.gap("busy_orders", c, 0, "price") for c in PRICE_TEXTS)}) UNION ALL
      SELECT 3, 'correlation', 'Why do ' || var1 || ' and ' || var2 || ' move together?'
        FROM ({" UNION ALL ".join(st.r_sql(a, b, "busy_orders") for a, b in combinations(PRICE_NUMBERS, 2))}) WHERE abs(r) >= 0.7 UNION ALL
      SELECT 4, 'trend', 'What drives the ' || direction || ' trend of ' || metric || ' over ordered_on?'
        FROM ({ts.trends(" UNION ALL ".join(ts.months("busy_orders", "ordered_on", c) for c in PRICE_NUMBERS))}) WHERE strength <> 'slight' UNION ALL
      SELECT 5, 'outliers', 'Which rows have an extreme ' || "column" || '?' FROM ({st.outlier_report("busy_orders", PRICE_NUMBERS)}))"""))
def _(t):
    return questions.suggest_questions(t.busy_orders, seg.BUSY_TYPES)
