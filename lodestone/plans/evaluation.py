"""Evaluation and monitoring queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOP_JUDGE, STOP_METRIC, atomic_claims
from ..operators import evaluation as E
from ..operators import monitoring as M
from .common import read, user_turns

B = r"[\x20\x09-\x0D]"
NB = r"[^\x20\x09-\x0D]+"
JUDGE = ", ".join(f"'{w}'" for w in STOP_JUDGE)
METRIC = ", ".join(f"'{w}'" for w in STOP_METRIC)


def content_sql(text: str) -> str:
    marks = r"""[\.,()$\[\]''"]"""
    return f"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({text}, '{NB}'), lambda w: regexp_replace(w, '^{marks}+|{marks}+$', '', 'g')),
lambda w: length(w) > 1 AND lower(w) NOT IN ({JUDGE})), lambda w: lower(w)))"""


def metric_sql(text: str) -> str:
    marks = r"[\.,()$]"
    return f"""list_distinct(list_filter(list_transform(list_filter(regexp_extract_all({text}, '{NB}'), lambda w: lower(w) NOT IN ({METRIC})),
lambda w: lower(regexp_replace(w, '^{marks}+|{marks}+$', '', 'g'))), lambda w: w <> ''))"""


def claims_sql(text: str) -> str:
    return f"""list_filter(list_transform(regexp_split_to_array(trim({text}), '[.;]{B}+'), lambda p: regexp_replace(p, '^{B}+|{B}+$', '', 'g')), lambda p: length(p) > 3)"""


def _turns(spark, sf):
    """(conv_id, turn, question, answer, context, ground_truth) of every assistant turn that a user turn precedes.

    The question is the last user turn before; the context is that and the user turn before it; the assistant's next
    turn, else the one before, else the answer itself, stands for the truth.
    """
    role = Window.partitionBy("conv_id", "role").orderBy("turn")
    rows = read(spark, sf, "conversations").withColumns({"earlier": F.lag("text").over(role), "later": F.lead("text").over(role)})
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.struct("text", "earlier")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("asked", asked).filter("role = 'assistant' AND asked.text IS NOT NULL AND text IS NOT NULL")
    context, truth = F.concat_ws("\n", "asked.earlier", "asked.text"), F.coalesce("later", "earlier", "text")
    return rows.select("conv_id", "turn", F.col("asked.text").alias("question"), F.col("text").alias("answer"), context.alias("context"), truth.alias("ground_truth"))


TURNS = """u AS (SELECT *, lag(text) OVER w AS earlier, lead(text) OVER w AS later FROM conversations WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)),
v AS (SELECT *, last_value(CASE WHEN role = 'user' THEN {'q': text, 'e': earlier} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM u),
t AS (SELECT conv_id, turn, asked.q AS question, text AS answer, concat_ws(chr(10), asked.e, asked.q) AS context, coalesce(later, earlier, text) AS ground_truth
FROM v WHERE role = 'assistant' AND asked.q IS NOT NULL AND text IS NOT NULL)"""


def atomic_claims_query(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(atomic_claims(F.col("text"))).cast("bigint").alias("n"), F.array_join(atomic_claims(F.col("text")), "|").alias("claims"))


def nli_label(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", E.nli_label(F.col("question"), F.col("answer")).alias("label"))


def _overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), 1))"


NLI = f"""WITH {TURNS}, w AS (SELECT conv_id, turn, {content_sql("question")} AS a, {content_sql("answer")} AS b FROM t)
SELECT conv_id, turn, CASE WHEN {_overlap("a", "b")} >= 0.6 THEN 'entailment' WHEN {_overlap("a", "b")} >= 0.2 THEN 'neutral' ELSE 'contradiction' END AS label FROM w"""


def faithfulness(spark, sf):
    return E.faithfulness(_turns(spark, sf), "conv_id", "turn")


FAITH = f"""WITH {TURNS}, c AS (SELECT conv_id, turn, unnest({claims_sql("answer")}) AS claim, context FROM t), w AS (SELECT conv_id, turn, {content_sql("claim")} AS a, {content_sql("context")} AS b FROM c),
s AS (SELECT conv_id, turn, count(*) AS claims, count(*) FILTER ({_overlap("a", "b")} >= 0.6) AS ok FROM w GROUP BY conv_id, turn)
SELECT t.conv_id, t.turn, coalesce(claims, 0) AS claims, round(coalesce(ok, 0)::DOUBLE / greatest(coalesce(claims, 0), 1), 3) AS faithfulness,
round(1 - coalesce(ok, 0)::DOUBLE / greatest(coalesce(claims, 0), 1), 3) AS hallucination_rate FROM t LEFT JOIN s USING (conv_id, turn)"""


def claim_support(spark, sf):
    """Claims of answers against the question, then against the user's last two turns."""
    rows = _turns(spark, sf).select("conv_id", "answer", F.col("question").alias("context"), F.col("context").alias("corpus"))
    return E.claim_support(rows).groupBy("support").agg(F.count("*").alias("n"))


SUPPORT = f"""WITH {TURNS}, c AS (SELECT unnest({claims_sql("answer")}) AS claim, question, context FROM t),
w AS (SELECT {content_sql("claim")} AS a, {content_sql("question")} AS b, {content_sql("context")} AS d FROM c)
SELECT CASE WHEN {_overlap("a", "b")} >= 0.6 THEN 'supported' WHEN {_overlap("a", "d")} >= 0.6 THEN 'retrieval_induced' ELSE 'generation_induced' END AS support, count(*) AS n FROM w GROUP BY 1"""


def rag_metrics(spark, sf):
    """Means of the eight metrics over all answers, and the hallucination rate."""
    return E.mean_metrics(E.rag_metrics(_turns(spark, sf)))


def _means_sql() -> str:
    def part(x: str, w: str) -> str:
        return f"round(avg(len({x})::DOUBLE / greatest(len({w}), 1)), 3)"

    both, union = "list_intersect(a, g)", "list_distinct(list_concat(a, g))"
    noise = "list_filter(list_filter(a, lambda w: NOT list_contains(c, w)), lambda w: NOT list_contains(q, w))"
    columns = {
        "faithfulness": part("list_intersect(a, c)", "a"), "answer_relevancy": part("list_intersect(a, q)", "a"), "context_precision": part("list_intersect(c, g)", "c"),
        "context_recall": part("list_intersect(g, c)", "g"), "context_entity_recall": part("list_intersect(g, c)", "g"), "answer_correctness": part(both, union),
        "answer_similarity": part(both, union), "noise_sensitivity": part(noise, "a"),
    }
    made = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"""WITH {TURNS}, w AS (SELECT {metric_sql("question")} AS q, {metric_sql("answer")} AS a, {metric_sql("context")} AS c, {metric_sql("ground_truth")} AS g FROM t), r AS (SELECT {made} FROM w),
h AS (SELECT *, round(1 - faithfulness, 3) AS hallucination_rate FROM r), m AS (SELECT metric, mean FROM (UNPIVOT h ON COLUMNS(*) INTO NAME metric VALUE mean))"""


def pass_counts(spark, sf):
    """How many answers pass each metric, and all together."""
    return E.pass_counts(E.rag_metrics(_turns(spark, sf)))


def _passes_sql() -> str:
    share = lambda x, w: f"len({x})::DOUBLE / greatest(len({w}), 1)"
    noise = "list_filter(list_filter(a, lambda w: NOT list_contains(c, w)), lambda w: NOT list_contains(q, w))"
    truth = share("list_intersect(a, g)", "list_distinct(list_concat(a, g))")
    values = [share("list_intersect(a, c)", "a"), share("list_intersect(a, q)", "a"), share("list_intersect(c, g)", "c"), share("list_intersect(g, c)", "g"), share("list_intersect(g, c)", "g"), truth, truth]
    parts = [f"SELECT '{m}' AS metric, count(*) FILTER ({v} >= {t}) AS passed, count(*) AS n FROM w" for (m, t), v in zip(E.FLOORS.items(), values, strict=True)]
    parts += [f"SELECT '{m}', count(*) FILTER ({share(noise, 'a')} <= {t}), count(*) FROM w" for m, t in E.CEILINGS.items()]
    return f"""WITH {TURNS}, w AS (SELECT {metric_sql("question")} AS q, {metric_sql("answer")} AS a, {metric_sql("context")} AS c, {metric_sql("ground_truth")} AS g FROM t),
m AS ({" UNION ALL ".join(parts)}), o AS (SELECT * FROM m UNION ALL SELECT 'overall', CAST(sum(passed) AS BIGINT), CAST(sum(n) AS BIGINT) FROM m) SELECT metric, passed, n, round(passed::DOUBLE / greatest(n, 1), 3) AS rate FROM o"""


def metric_gate(spark, sf):
    return E.gate(rag_metrics(spark, sf))


GATE = f"""{_means_sql()}, g(metric, threshold, ceiling) AS (VALUES {", ".join(f"('{m}', {t}::DOUBLE, false)" for m, t in E.FLOORS.items())}, ('noise_sensitivity', 0.3::DOUBLE, true))
SELECT metric, mean, threshold, CASE WHEN mean IS NULL THEN 'SKIP' WHEN (ceiling AND mean <= threshold) OR (NOT ceiling AND mean >= threshold) THEN 'PASS' ELSE 'FAIL' END AS status FROM g LEFT JOIN m USING (metric)"""


def citation_check(spark, sf):
    """Statements about every order that cite it, and every third that cites the next order instead."""
    orders = read(spark, sf, "orders")
    text = F.format_string("Order %s has status %s and priority %s", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    corpus = orders.select(F.col("o_orderkey").cast("string").alias("id"), text.alias("text"))
    cited = (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("string")
    answers = orders.select(F.col("o_orderkey").alias("key"), F.concat(text, F.lit(". [order "), cited, F.lit("]")).alias("answer"))
    return E.check_citations(answers, corpus, "key", r"order\s*([0-9]+)")


def _citation_sql() -> str:
    text = "printf('Order %s has status %s and priority %s', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)"
    return f"""WITH o AS (SELECT o_orderkey AS key, {text} AS text, CAST(o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS cited FROM orders),
a AS (SELECT key, text || '. [order ' || cited || ']' AS answer FROM o), x AS (SELECT key, regexp_replace(answer, '(?i)\\[order\\s*[0-9]+\\]', '', 'g') AS bare,
unnest(list_distinct(regexp_extract_all(lower(answer), 'order\\s*([0-9]+)', 1))) AS id FROM a),
j AS (SELECT x.key, id, {content_sql("bare")} AS a, CASE WHEN o.text IS NULL THEN [] ELSE {content_sql("o.text")} END AS b, o.text FROM x LEFT JOIN o ON CAST(o.key AS VARCHAR) = id)
SELECT key, count(id) AS cited, bool_and(text IS NOT NULL AND {_overlap("a", "b")} >= 0.6) AS valid FROM j GROUP BY key"""


def self_consistency(spark, sf):
    """Agreement of each conversation's assistant turns."""
    rows = read(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", F.col("turn").alias("sample"), F.col("text").alias("answer"))
    return E.self_consistency(rows, "conv_id")


CONSISTENT = f"""WITH s AS (SELECT conv_id, turn, list_distinct(list_concat(regexp_extract_all(text, '\\b(1[0-9]{{3}})\\b', 1), list_filter({content_sql("text")}, lambda w: length(w) > 4))) AS s
FROM conversations WHERE role = 'assistant'), k AS (SELECT a.conv_id, a.turn, count(*) AS k FROM s a JOIN s b USING (conv_id) WHERE CASE WHEN len(list_concat(a.s, b.s)) = 0 THEN 1
ELSE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) END >= 0.5 GROUP BY ALL), n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY conv_id)
SELECT conv_id, round(max(k)::DOUBLE / any_value(n), 3) AS agreement, max(k)::DOUBLE / any_value(n) >= 0.6 AS consistent FROM k JOIN n USING (conv_id) GROUP BY conv_id"""


def guardrail_flags(spark, sf):
    """Input flags of every turn, joined by commas."""
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(M.input_flags(F.col("text")), ",").alias("flags"))


def _flag_sql(text: str) -> str:
    parts = [f"CASE WHEN regexp_matches({text}, '{p}') THEN 'input_pii:{k}' END" for k, p in M.PII.items()]
    parts.append(f"CASE WHEN regexp_matches({text}, '(?i){'|'.join(M.INJECTION)}') THEN 'input_injection' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ',')"


def document_guardrails(spark, sf):
    """Input flags of every document."""
    return read(spark, sf, "documents").select("doc_id", F.array_join(M.input_flags(F.col("text")), ",").alias("flags"))


def groundedness(spark, sf):
    """Share of each answer's words that the user's last two turns have."""
    return _turns(spark, sf).select("conv_id", "turn", F.round(M.grounded_share(F.col("answer"), F.col("context")), 4).alias("grounded"))


def _ascii(text: str, longer: int = 0) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > {longer}))"


GROUNDED = f"""WITH {TURNS}, w AS (SELECT conv_id, turn, {_ascii("answer", 3)} AS a, {_ascii("context")} AS c FROM t)
SELECT conv_id, turn, round(len(list_intersect(a, c))::DOUBLE / greatest(len(a), 1), 4) AS grounded FROM w"""


def output_flags(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(M.output_flags(F.col("answer"), F.col("context")), ",").alias("flags"))


def _output_sql() -> str:
    leaks = [f"CASE WHEN regexp_matches(answer, '{p}') THEN 'output_pii_leak:{k}' END" for k, p in M.PII.items()]
    toxic = f"CASE WHEN list_has_any(regexp_extract_all(lower(answer), '[a-z]+'), [{', '.join(repr(w) for w in M.TOXIC)}]) THEN 'output_toxicity' END"
    loose = f"CASE WHEN share < 0.5 AND NOT contains(lower(answer), '{M.ABSTAIN.replace(chr(39), chr(39) * 2)}') THEN 'output_ungrounded:' || printf('%.2f', round(share, 2)) END"
    return f"""WITH {TURNS}, w AS (SELECT *, {_ascii("answer", 3)} AS a, {_ascii("context")} AS c FROM t), s AS (SELECT *, len(list_intersect(a, c))::DOUBLE / greatest(len(a), 1) AS share FROM w)
SELECT conv_id, turn, array_to_string(list_filter([{", ".join([*leaks, toxic, loose])}], lambda x: x IS NOT NULL), ',') AS flags FROM s"""


def online_eval(spark, sf):
    """Faithfulness and relevance proxies of each answer."""
    faith, relevant = M.online_scores(F.col("question"), F.col("answer"), F.col("context"))
    return _turns(spark, sf).select("conv_id", "turn", faith.alias("faithfulness"), relevant.alias("relevance"))


ONLINE = f"""WITH {TURNS}, w AS (SELECT conv_id, turn, {_ascii("answer", 3)} AS a, {_ascii("context")} AS c, {_ascii("question", 3)} AS q FROM t)
SELECT conv_id, turn, round(len(list_intersect(a, c))::DOUBLE / greatest(len(a), 1), 3) AS faithfulness, round(len(list_intersect(a, q))::DOUBLE / greatest(len(q), 1), 3) AS relevance FROM w"""


def _traces(spark, sf):
    """Events as traces: value as latency, errors as blocked and failed."""
    e = read(spark, sf, "events")
    return e.select(
        (F.col("event_id") + 0).alias("request_id"),
        (F.col("value") * 100).alias("latency_ms"),
        M.cost_usd(F.col("event_id") % 1000, F.col("user_id")).alias("cost_usd"),
        F.when(F.col("event_type") != "error", (F.col("event_id") % 100) / 100).alias("faithfulness"),
        (F.col("event_type") == "signup").alias("abstained"),
        F.col("event_type").isin("error", "signup").alias("flagged"),
        (F.col("event_type") == "error").alias("failed"),
    )


TRACES = """t AS (SELECT value * 100 AS latency_ms, ((event_id % 1000) * 0.15::DOUBLE + user_id * 0.6::DOUBLE) / 1000000 AS cost_usd,
CASE WHEN event_type <> 'error' THEN (event_id % 100)::DOUBLE / 100 END AS faithfulness, event_type = 'signup' AS abstained,
event_type IN ('error', 'signup') AS flagged, event_type = 'error' AS failed FROM events)"""
FLEET = f"""{TRACES}, l AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS i, count(*) OVER () AS n FROM t WHERE latency_ms > 0),
m AS (SELECT count(*) AS requests, round(median(latency_ms) FILTER (latency_ms > 0), 1) AS p50_latency_ms, round(sum(cost_usd), 4) AS total_cost_usd, round(avg(faithfulness), 3) AS mean_faithfulness,
round(count(*) FILTER (abstained)::DOUBLE / count(*), 3) AS abstention_rate, round(count(*) FILTER (flagged)::DOUBLE / count(*), 3) AS guardrail_block_rate,
round(count(*) FILTER (failed)::DOUBLE / count(*), 3) AS error_rate, (SELECT round(min(latency_ms), 1) FROM l WHERE i = greatest(1, floor(0.95::DOUBLE * n))) AS p95_latency_ms FROM t)"""


def fleet_metrics(spark, sf):
    return M.fleet_metrics(_traces(spark, sf))


def alerts(spark, sf):
    return M.alerts(M.fleet_metrics(_traces(spark, sf)))


ALERTS = f"""WITH {FLEET}, u AS (SELECT unnest([{", ".join(f"{{'metric': '{m}', 'value': {m}::DOUBLE, 'op': '{o}', 'threshold': {t}::DOUBLE}}" for m, o, t in M.ALERTS)}], recursive := true) FROM m)
SELECT metric, value, op, threshold FROM u WHERE (op = 'gt' AND value > threshold) OR (op = 'lt' AND value < threshold)"""


def psi_drift(spark, sf):
    """Stability of event values from the first half of January to the second."""
    e = read(spark, sf, "events")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    return M.psi(e.filter(F.col("ts") < middle), e.filter(F.col("ts") >= middle), "value")


PSI = """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(least(4, floor((value - lo) / (hi - lo) * 5)) AS INTEGER) AS bin, ts < TIMESTAMP '2024-01-16' AS base FROM events, r),
n AS (SELECT count(*) FILTER (base) AS nb, count(*) FILTER (NOT base) AS nl FROM b), c AS (SELECT i AS bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS l FROM range(5) x(i) LEFT JOIN b ON b.bin = i GROUP BY i),
p AS (SELECT (b + 1e-6) / (nb + 5e-6) AS pb, (l + 1e-6) / (nl + 5e-6) AS pl FROM c, n) SELECT round(sum((pl - pb) * ln(pl / pb)), 6) AS psi FROM p"""


def centroid_drift(spark, sf):
    """Distance of the mean vectors of labels 0 to 4 and of the others."""
    v = read(spark, sf, "embeddings")
    return M.centroid_drift(v.filter("label < 5"), v.filter("label >= 5"))


CENTROID = """WITH x AS (SELECT label < 5 AS base, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT i, avg(x) FILTER (base) AS a, avg(x) FILTER (NOT base) AS b FROM x GROUP BY i)
SELECT round(sqrt(sum(pow(a - b, 2))), 6) AS drift FROM m"""


def cost_rollup(spark, sf):
    """Tokens and cost of both price lists by role."""
    t = read(spark, sf, "conversations").withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    cost = lambda m: F.round(F.sum(M.cost_usd(F.col("tokens"), F.col("tokens"), m)), 6).alias(f"{m}_usd")
    return t.groupBy("role").agg(F.sum("tokens").cast("bigint").alias("tokens"), cost("small"), cost("strong"))


def cascade_route(spark, sf):
    """Which model answers: the strong one below a confidence of one half."""
    c = M.confidence(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", c.cast("double").alias("confidence"), (c < 0.5).alias("escalated"))


CASCADE = f"""SELECT conv_id, turn, CAST(c AS DOUBLE) AS confidence, c < 0.5 AS escalated FROM (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'i don''t know') OR contains(lower(text), 'not sure') OR contains(lower(text), 'cannot') THEN 0.1
ELSE greatest(0.2, 1.0 - 0.25 * ({" + ".join(f"contains(lower(text), '{h}')::INT" for h in M.HEDGES)})) END AS c FROM conversations)"""


def sampled_eval(spark, sf):
    return M.sampled(read(spark, sf, "events").select("event_id"), "event_id", 0.1)


def canary_split(spark, sf):
    return M.canary(read(spark, sf, "events").select("event_id"), "event_id", 0.3)


def feedback_candidates(spark, sf):
    """Traces with a thumbs-down: errors stand for feedback -1."""
    traces = _traces(spark, sf).select("request_id")
    feedback = read(spark, sf, "events").filter("event_type IN ('error', 'purchase')").select(F.col("event_id").alias("request_id"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("feedback"))
    return traces.join(feedback, "request_id", "left").filter("feedback = -1").select("request_id")


def exact_cache_key(spark, sf):
    return M.exact_cache_hits(user_turns(spark, sf)).select("id.conv_id", "id.turn", "hit")


def lru_cache(spark, sf):
    return M.lru_content(user_turns(spark, sf)).select("key", "last_used.conv_id", "last_used.turn")


KEY = f"sha256(trim(regexp_replace(lower(text), '{B}+', ' ', 'g')))"

QUERIES = {
    "atomic_claims": (
        atomic_claims_query,
        f"SELECT conv_id, turn, CAST(len({claims_sql('text')}) AS BIGINT) AS n, array_to_string({claims_sql('text')}, '|') AS claims FROM conversations",
    ),
    "nli_label": (nli_label, NLI),
    "faithfulness": (faithfulness, FAITH),
    "claim_support": (claim_support, SUPPORT),
    "rag_metrics": (rag_metrics, f"{_means_sql()} SELECT metric, mean FROM m"),
    "metric_gate": (metric_gate, GATE),
    "pass_counts": (pass_counts, _passes_sql()),
    "citation_check": (citation_check, _citation_sql()),
    "self_consistency": (self_consistency, CONSISTENT),
    "guardrail_flags": (guardrail_flags, f"SELECT conv_id, turn, {_flag_sql('text')} AS flags FROM conversations"),
    "document_guardrails": (document_guardrails, f"SELECT doc_id, {_flag_sql('text')} AS flags FROM documents"),
    "groundedness": (groundedness, GROUNDED),
    "output_flags": (output_flags, _output_sql()),
    "online_eval": (online_eval, ONLINE),
    "fleet_metrics": (fleet_metrics, f"WITH {FLEET} SELECT * FROM m"),
    "alerts": (alerts, ALERTS),
    "psi_drift": (psi_drift, PSI),
    "centroid_drift": (centroid_drift, CENTROID),
    "cost_rollup": (
        cost_rollup,
        """WITH t AS (SELECT role, greatest(1, length(text) // 4) AS tokens FROM conversations) SELECT role, CAST(sum(tokens) AS BIGINT) AS tokens,
round(sum((tokens * 0.15::DOUBLE + tokens * 0.6::DOUBLE) / 1000000), 6) AS small_usd, round(sum((tokens * 2.5::DOUBLE + tokens * 10::DOUBLE) / 1000000), 6) AS strong_usd FROM t GROUP BY role""",
    ),
    "cascade_route": (cascade_route, CASCADE),
    "sampled_eval": (sampled_eval, "SELECT event_id, (event_id + 1) % 10 = 0 AS sampled FROM events"),
    "canary_split": (canary_split, "SELECT event_id, (event_id + 1) % 3 = 0 AS canary FROM events"),
    "feedback_candidates": (feedback_candidates, "SELECT event_id AS request_id FROM events WHERE event_type = 'error'"),
    "exact_cache_key": (exact_cache_key, f"SELECT conv_id, turn, row_number() OVER (PARTITION BY {KEY} ORDER BY conv_id, turn) > 1 AS hit FROM conversations WHERE role = 'user'"),
    "lru_cache": (
        lru_cache,
        f"""SELECT key, conv_id, turn FROM (SELECT {KEY} AS key, conv_id, turn FROM conversations WHERE role = 'user'
QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY conv_id DESC, turn DESC) = 1) ORDER BY conv_id DESC, turn DESC LIMIT 256""",
    ),
}
