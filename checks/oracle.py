"""The same results in SQL, for DuckDB over the given tables."""

from __future__ import annotations

from checks.queries import LITERAL_QUESTIONS, MAX_WORDS, NEIGHBOUR_SEED, RULE_COUNTRIES, RULE_WORDS
from riskloom import fixed_values as fixed
from riskloom.functions.text import SPACE

TX = """
tx AS (
  SELECT concat_ws('-', cast(l_orderkey AS varchar), cast(l_linenumber AS varchar), cast(l_partkey AS varchar),
                   cast(l_suppkey AS varchar), cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar),
                   cast(cast(l_quantity AS int) AS varchar)) AS transaction_id,
         l_shipdate AS timestamp,
         concat('ACC-', lpad(cast(l_suppkey AS varchar), greatest(5, length(cast(l_suppkey AS varchar)))::int, '0')) AS account_id,
         concat('CUS-', lpad(cast(o_custkey AS varchar), greatest(5, length(cast(o_custkey AS varchar)))::int, '0')) AS customer_id,
         cast((CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * cast(l_extendedprice AS decimal(18,2)) AS decimal(18,2)) AS amount,
         o_orderpriority AS transaction_type,
         c_mktsegment AS merchant_category,
         n_name AS country,
         CASE WHEN l_tax >= 0.08 AND l_linenumber >= 6 THEN 1 ELSE 0 END AS fraud_flag,
         round(0.2 + 33 * l_discount, 4) AS volatility_index
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""

ENRICHED = TX + """,
r AS (
  SELECT *, cast(sum(amount) OVER w AS double) / count(amount) OVER w AS rolling_avg_amount
  FROM tx WINDOW w AS (PARTITION BY account_id ORDER BY timestamp, transaction_id
                       ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (
  SELECT *, CASE WHEN volatility_index > 1.5 THEN 1.0::double ELSE 0.0::double END AS vf,
         CASE WHEN abs(cast(amount AS double)) > 3 * abs(rolling_avg_amount) THEN 1.0::double ELSE 0.0::double END AS df
  FROM r),
e AS (
  SELECT *, round(cast(0.40 AS double) * vf + cast(0.35 AS double) * df + cast(0.25 AS double) * fraud_flag, 4) AS risk_score
  FROM f)"""

POINTS = "cast(round(risk_score * 10000) AS bigint)"
MEAN = f"(cast(sum({POINTS}) AS double) / (count(risk_score) * 10000.0::double))"
MEAN4 = f"round({MEAN}, 4) AS avg_risk_score"
HIGH = "cast(sum(CASE WHEN risk_score >= 0.6 THEN 1 ELSE 0 END) AS bigint)"
LEDGER = ("transaction_id, timestamp, account_id, customer_id, amount, transaction_type, merchant_category, "
          "country, fraud_flag, volatility_index, risk_score")
TOP = f"top AS (SELECT {LEDGER} FROM e ORDER BY risk_score DESC, amount DESC, transaction_id LIMIT 10)"

AMOUNT = "cast(amount AS double) AS amount"
GRAPH = "transaction_id, timestamp, account_id, customer_id, amount, transaction_type, country, risk_score"


def _pairs(source: str) -> str:
    return f"""
p AS (
  SELECT customer_id, account_id, sum(amount) AS net, sum(abs(amount)) AS gross, max(risk_score) AS risk,
         sum({POINTS}) AS points, count(risk_score) AS scored
  FROM {source} GROUP BY customer_id, account_id),
ed AS (
  SELECT customer_id AS "from", account_id AS "to", abs(cast(net AS double)) AS weight,
         1 + ln(1 + abs(cast(net AS double))) / 2 AS width, risk,
         CASE WHEN risk >= 0.5 THEN '{fixed.RISKY_EDGE_COLOR}' ELSE '{fixed.EDGE_COLOR}' END AS color
  FROM p),
ends AS (
  SELECT customer_id AS id, 'customer' AS type, account_id AS other FROM p
  UNION ALL SELECT account_id, 'account', customer_id FROM p),
lk AS (SELECT "from" AS id, "to" AS other FROM ed UNION ALL SELECT "to", "from" FROM ed),
part AS (
  SELECT id, cast(regexp_extract(min(other), '(\\d+)$', 1) AS bigint) % 7 AS community FROM ends GROUP BY id)"""


UNKNOWN = ENRICHED + """,
gaps AS (SELECT * REPLACE (CASE WHEN transaction_type <> '1-URGENT' THEN risk_score END AS risk_score,
                           CASE WHEN country <> 'NATION_11' THEN volatility_index END AS volatility_index) FROM e)"""
SUSPICIOUS = ENRICHED + ",\ns AS (SELECT * FROM e WHERE risk_score >= 0.2)," + _pairs("s")
PULL = "g AS (SELECT * FROM e WHERE risk_score >= 0.2 ORDER BY risk_score DESC, transaction_id LIMIT 300)"
PAGE = "g AS (SELECT * FROM e WHERE risk_score >= 0.2 ORDER BY risk_score DESC, transaction_id LIMIT 150)"
SHOWN_EDGES = '"from", "to", round(weight, 2) AS weight, round(width, 6) AS width, risk, color'


def _array(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _rules(text: str, rules, default: str) -> str:
    lowered = f"lower(coalesce({text}, ''))"
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({lowered}, '{w}')" for w in words) + f" THEN '{name}'"
        for name, words in rules)
    return f"CASE {cases} ELSE '{default}' END"


def _dollars(amount: str, decimals: int) -> str:
    sign = f"CASE WHEN {amount} < 0 THEN '-' ELSE '' END"
    if decimals:
        return (f"concat({sign}, '$', format('{{:,}}', cast(floor(abs({amount})) AS bigint)), '.', "
                f"lpad(cast(cast((abs({amount}) - floor(abs({amount}))) * 100 AS int) AS varchar), 2, '0'))")
    return f"concat({sign}, '$', format('{{:,}}', cast(round(abs({amount})) AS bigint)))"


CHANNEL = _rules("transaction_type", fixed.CHANNEL_RULES, fixed.CHANNEL_DEFAULT)
CODE = ("coalesce(CASE country " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.COUNTRY_CODES.items())
        + f" END, '{fixed.COUNTRY_CODE_DEFAULT}')")
TIME = "strftime(timestamp, '%b %d, %Y %I:%M %p')"
MONTH = "strftime(timestamp, '%Y-%m')"

DOCS = "docs AS (SELECT concat('doc_', doc_id, '.txt') AS filename, text AS content FROM documents)"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _words(text: str) -> str:
    return f"[x FOR x IN regexp_split_to_array({text}, '{SPACE}+') IF x <> '']"


def _chunks(separator: str, max_words: int, name: str = "concat('doc_', doc_id, '.txt')", text: str = "text") -> str:
    """Greedy packing as recursion over numbered paragraphs."""
    return f"""
docs AS (SELECT {name} AS filename, {text} AS content FROM documents),
para AS (
  SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY o) AS i, t, len({_words('t')}) AS n
  FROM (SELECT filename, generate_subscripts(a, 1) AS o, {_strip('unnest(a)')} AS t
        FROM (SELECT filename, regexp_split_to_array(content, '{separator}') AS a FROM docs))
  WHERE t <> ''),
pack AS (
  SELECT filename, i, n AS words, 0 AS c FROM para WHERE i = 1
  UNION ALL
  SELECT q.filename, q.i, CASE WHEN pack.words + q.n > {max_words} THEN q.n ELSE pack.words + q.n END,
         CASE WHEN pack.words + q.n > {max_words} THEN pack.c + 1 ELSE pack.c END
  FROM pack JOIN para q ON q.filename = pack.filename AND q.i = pack.i + 1),
cut AS (
  SELECT filename, c, string_agg(t, chr(10) || chr(10) ORDER BY i) AS content
  FROM pack JOIN para USING (filename, i) GROUP BY filename, c),
ch AS (
  SELECT format('chunk_{{:04d}}', row_number() OVER (ORDER BY filename, c) - 1) AS chunk_id, content, filename
  FROM cut)"""


CHUNKS = _chunks("\\n", MAX_WORDS)


def _embedding(name: str, source: str, key: str, text: str) -> str:
    return f"""
{name}_w AS (
  SELECT {key}, cast(('0x' || substr(md5(w), 1, 8)) AS bigint) % 64 AS slot, count(*) AS n
  FROM (SELECT {key}, unnest({_words(text)}) AS w FROM {source}) GROUP BY ALL),
{name}_l AS (SELECT {key}, sqrt(cast(sum(n * n) AS double)) AS len FROM {name}_w GROUP BY {key}),
{name}_s AS (SELECT {key}, slot, cast(n / len AS float) AS v FROM {name}_w JOIN {name}_l USING ({key})),
{name} AS (
  SELECT {key}, list(coalesce(v, 0::float) ORDER BY slots.slot) AS embedding
  FROM (SELECT DISTINCT {key} FROM {name}_s) k CROSS JOIN (SELECT unnest(range(64)) AS slot) slots
  LEFT JOIN {name}_s USING ({key}, slot) GROUP BY {key})"""


LITERALS = ", ".join(f"('q{i}', '{q}')" for i, q in enumerate(LITERAL_QUESTIONS))
QUESTIONS = f"""
qs AS (
  SELECT concat_ws('-', cast(conv_id AS varchar), cast(turn AS varchar)) AS query_id, text AS query
  FROM conversations WHERE role = 'user'
  UNION ALL SELECT * FROM (VALUES {LITERALS}) AS v(query_id, query))"""

ROUTE = f"""CASE WHEN len([k FOR k IN {_array(fixed.FLASH_KEYWORDS)} IF contains(lower(query), k)]) > 0
         THEN 'flash' ELSE 'pro' END"""

CONTEXT = CHUNKS + "," + QUESTIONS + "," + _embedding("ce", "ch", "chunk_id", "content") + "," + _embedding(
    "qe", "qs", "query_id", "query") + """,
hit AS (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id,
               round(1 - list_cosine_similarity(qe.embedding::double[], ce.embedding::double[]), 9) AS distance
        FROM qe CROSS JOIN ce)
  QUALIFY rank <= 5),
ctx AS (
  SELECT query_id,
         string_agg('[Source: ' || filename || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM hit JOIN ch USING (chunk_id) GROUP BY query_id),
src AS (
  SELECT query_id, string_agg(filename, ',' ORDER BY rank) AS sources,
         string_agg(filename, ', ' ORDER BY rank) AS listed
  FROM (SELECT query_id, filename, min(rank) AS rank FROM hit JOIN ch USING (chunk_id) GROUP BY ALL) GROUP BY query_id)"""

SEARCH = """SELECT query_id, id, round(distance, 6) AS distance, rank FROM (
  SELECT q.vec_id AS query_id, b.vec_id AS id, d AS distance,
         cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY d, b.vec_id) AS int) AS rank
  FROM embeddings q CROSS JOIN embeddings b,
       LATERAL (SELECT round(1 - list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 9) AS d))
WHERE rank <= 5"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _ledger(part: str) -> str:
    return f"""
mem AS (
  SELECT DISTINCT customer_id, account_id, gross, points, scored, community
  FROM p JOIN {part} ON {part}.id = customer_id OR {part}.id = account_id)
SELECT concat('{fixed.RING_LABEL}', z.community) AS community_ring, total_nodes, customer_entities,
       associated_bank_accounts, aggregate_volume, vulnerability_risk_rating
FROM (SELECT community, count(*) AS total_nodes,
             count(*) FILTER (WHERE starts_with(id, 'CUS')) AS customer_entities,
             count(*) FILTER (WHERE starts_with(id, 'ACC')) AS associated_bank_accounts
      FROM {part} GROUP BY community) z
JOIN (SELECT community, round(cast(sum(gross) AS double), 2) AS aggregate_volume,
             round(cast(sum(points) AS double) / (sum(scored) * 10000.0::double), 6) AS vulnerability_risk_rating
      FROM mem GROUP BY community) v ON z.community = v.community"""


def _nodes(part: str, palette: list[str]) -> str:
    return f"""
SELECT d.id, d.id AS label, type, cast(10 + 4 * degree AS int) AS size,
       ({_array(palette)})[cast(community % {len(palette)} AS int) + 1] AS color, cast(community AS bigint) AS community, degree
FROM (SELECT id, type, count(*) AS degree FROM ends GROUP BY id, type) d JOIN {part} ON {part}.id = d.id"""


def _hops(seed: str) -> str:
    return f"""
SELECT id, min(distance) AS distance FROM (
  SELECT id, 0 AS distance FROM lk WHERE id = '{seed}'
  UNION ALL SELECT other, 1 FROM lk WHERE id = '{seed}'
  UNION ALL SELECT other, 2 FROM lk WHERE id IN (SELECT other FROM lk WHERE id = '{seed}'))
GROUP BY id"""


def _describe(column: str) -> str:
    v = f"cast({column} AS double)"
    parts = [("count", f"cast(count({v}) AS double)"), ("mean", f"avg({v})"), ("std", f"stddev_samp({v})"),
             ("min", f"min({v})"), ("25%", f"quantile_cont({v}, 0.25)"), ("50%", f"quantile_cont({v}, 0.5)"),
             ("75%", f"quantile_cont({v}, 0.75)"), ("max", f"max({v})")]
    return "\nUNION ALL ".join(f"SELECT '{n}' AS statistic, round({x}, 6) AS value FROM e" for n, x in parts)


def _heatmap() -> str:
    values = ", ".join(f"('{n}', {r}::double, {c})" for n, (r, c) in fixed.COUNTRY_FALLBACK.items())
    (r0, g0, b0), (r1, g1, b1) = fixed.RISK_RAMP_FROM, fixed.RISK_RAMP_TO
    share = "((risk - 0.2::double) / 0.8::double)"
    rgb = ", ', ', ".join(f"cast(floor({a} - ({a} - {b}) * {share} + 0.5) AS bigint)"
                          for a, b in ((r0, r1), (g0, g1), (b0, b1)))
    r, g, b = fixed.COUNT_RGB
    return _with(ENRICHED + f""",
m AS (SELECT country, count(*) AS n, {MEAN4} FROM e GROUP BY country),
fb AS (SELECT * FROM (VALUES {values}) AS v(region, risk, n)),
rg AS (SELECT lower(n_name) AS region FROM nation UNION ALL SELECT region FROM fb),
h AS (
  SELECT rg.region, CASE WHEN m.country IS NOT NULL THEN avg_risk_score ELSE coalesce(fb.risk, 0.15::double) END AS risk,
         CASE WHEN m.country IS NOT NULL THEN m.n ELSE coalesce(fb.n, 150) END AS transactions
  FROM rg LEFT JOIN m ON lower(m.country) = lower(rg.region) LEFT JOIN fb ON fb.region = rg.region)""", f"""
SELECT region, round(risk, 4) AS risk, cast(transactions AS bigint) AS transactions,
       CASE WHEN risk >= 0.2 THEN concat('rgb(', {rgb}, ')') ELSE '{fixed.RISK_FAINT}' END AS risk_color,
       CASE WHEN transactions >= 100
            THEN concat('rgba({r}, {g}, {b}, ', printf('%.3f', 0.04::double + 0.96::double * least(1.0::double, transactions / 2000.0::double)), ')')
            ELSE 'rgba({r}, {g}, {b}, 0.04)' END AS count_color
FROM h""")


def _prompt() -> str:
    nl = "chr(10) || chr(10)"
    question = "'User Question: ' || query"
    pro = (f"'Use only what the context says.' || {nl} || 'Context follows.' || {nl} || '--- KNOWLEDGE BASE CONTEXT ---' || chr(10) || "
           f"coalesce(context, '{fixed.NO_CONTEXT}') || chr(10) || '--- END CONTEXT ---' || {nl} || "
           f"'Source documents used: ' || coalesce(listed, '') || {nl} || {question} || {nl} || 'Name the files you relied on.'")
    flash = f"'Use only what the context says.' || {nl} || {question} || {nl} || 'Answer in one sentence.'"
    return _recursive(CONTEXT, f"""
SELECT query_id, model_class,
       CASE model_class WHEN 'flash' THEN 'Gemini Flash ({fixed.FLASH_MODEL})' ELSE 'Gemini Pro ({fixed.PRO_MODEL})' END AS model,
       CASE model_class WHEN 'flash' THEN {flash} ELSE {pro} END AS prompt
FROM (SELECT *, {ROUTE} AS model_class FROM qs) LEFT JOIN ctx USING (query_id) LEFT JOIN src USING (query_id)""")


def _trailing(months: int) -> str:
    return f"SELECT *, {months} AS months FROM (SELECT * FROM t ORDER BY month DESC LIMIT {months})"


def _critical(source: str) -> str:
    return f"""
SELECT row_number() OVER (ORDER BY risk_score DESC, amount DESC, transaction_id) AS rank, transaction_id,
       transaction_type, {CHANNEL} AS channel, country, {CODE} AS country_code, printf('%.2f', risk_score) AS score,
       {_dollars('amount', 0)} AS amount, {TIME} AS time, '{fixed.LEDGER_STATUS}' AS status FROM {source}"""


def _mart_report(country: str | None = None) -> str:
    """Rows and columns of each written mart."""
    source = f"(SELECT * FROM e WHERE country = '{country}')" if country else "e"
    one = "transaction_count, avg_risk_score"
    marts = [
        ("metrics", "1 + 0 * count(*)", "total_transactions, fraud_count, avg_risk_score, high_risk_count"),
        ("risk_by_channel", "count(DISTINCT transaction_type)", f"transaction_type, {one}"),
        ("temporal_risk", f"count(DISTINCT {MONTH})", f"month, {one}"),
        ("geographical_risk", "count(DISTINCT country)", f"country, {one}, high_risk_count"),
        ("risk_distribution",
         "count(DISTINCT CASE WHEN risk_score = 0 THEN 0 WHEN risk_score <= 0.25 THEN 1 WHEN risk_score <= 0.5 THEN 2 "
         "WHEN risk_score <= 0.75 THEN 3 ELSE 4 END)", "risk_bucket, transaction_count"),
        ("critical_events", "least(10, count(*))", LEDGER),
        ("graph_pull", "least(300, count(*) FILTER (WHERE risk_score >= 0.2))", GRAPH),
    ]
    if country:
        return _with(ENRICHED, " UNION ALL ".join(
            f"SELECT '{when}{name}' AS mart, {rows} AS num_rows FROM {table}"
            for when, table in (("old ", "e"), ("", source)) for name, rows, _ in marts))
    return _with(ENRICHED, " UNION ALL ".join(
        f"SELECT '{name}' AS mart, {rows} AS num_rows, '{columns}' AS column_names FROM e"
        for name, rows, columns in marts))


def oracle_sql() -> dict[str, str]:
    trend = f"SELECT {MONTH} AS month, count(*) AS transaction_count, {MEAN4} FROM e GROUP BY ALL"
    change = "CASE WHEN lag({c}) OVER w <> 0 THEN round(100.0::double * ({c} - lag({c}) OVER w) / lag({c}) OVER w, 1) END AS {c}_change"
    changes = ", ".join(change.format(c=c) for c in ("transaction_count", "fraud_count", "high_risk_count"))
    severity = f"CASE WHEN risk_score = 0 THEN '{fixed.NO_RISK_LABEL}'"
    lower = 0.0
    for label, upper in fixed.SEVERITY_BUCKETS:
        severity += f" WHEN risk_score > {lower} AND risk_score <= {upper} THEN '{label}'"
        lower = upper
    severity += f" ELSE '{fixed.CRITICAL_LABEL}' END"
    enriched = _with(ENRICHED, """
SELECT * EXCLUDE (vf, df) REPLACE (cast(amount AS double) AS amount, round(rolling_avg_amount, 8) AS rolling_avg_amount) FROM e""")
    record = ("to_json({transaction_id: transaction_id, timestamp: strftime(timestamp, '%Y-%m-%d %H:%M:%S'), "
              "account_id: account_id, customer_id: customer_id, amount: amount, transaction_type: transaction_type, "
              "merchant_category: merchant_category, country: country, fraud_flag: fraud_flag, "
              "volatility_index: volatility_index, risk_score: risk_score})")
    columns = "transaction_id, timestamp, account_id, customer_id, amount, transaction_type, merchant_category, " \
              "country, fraud_flag, volatility_index"
    no_group = _with(SUSPICIOUS + ",\none AS (SELECT DISTINCT id, 0 AS community FROM ends),", _ledger("one"))
    found = _recursive(CONTEXT, f"""
SELECT query_id, query, coalesce(context, '{fixed.NO_CONTEXT}') AS context, coalesce(sources, '') AS sources
FROM qs LEFT JOIN ctx USING (query_id) LEFT JOIN src USING (query_id)""")
    return {
        "transactions": _with(TX, f"SELECT * REPLACE ({AMOUNT}) FROM tx"),
        "enriched": enriched,
        "enriched_split_accounts": enriched,
        "enriched_from_buckets": enriched,
        "risk_components": _with(ENRICHED, """
SELECT transaction_id, vf AS volatility_flag, df AS amount_deviation, cast(fraud_flag AS double) AS fraud_component FROM e"""),
        "high_risk_transactions": _with(ENRICHED, "SELECT transaction_id, risk_score FROM e WHERE risk_score >= 0.6"),
        "kpi_summary": _with(ENRICHED, f"""
SELECT count(*) AS total_transactions, cast(sum(CASE WHEN fraud_flag = 1 THEN 1 ELSE 0 END) AS bigint) AS fraud_count,
       {MEAN} AS avg_risk_score, {HIGH} AS high_risk_count FROM e"""),
        "risk_by_channel": _with(ENRICHED, f"SELECT transaction_type, count(*) AS transaction_count, {MEAN4} FROM e GROUP BY ALL"),
        "monthly_trend": _with(ENRICHED, trend),
        "country_risk": _with(ENRICHED, f"""
SELECT country, count(*) AS transaction_count, {MEAN4}, {HIGH} AS high_risk_count FROM e GROUP BY ALL"""),
        "risk_distribution": _with(ENRICHED, f"SELECT {severity} AS risk_bucket, count(*) AS transaction_count FROM e GROUP BY ALL"),
        "critical_events": _with(ENRICHED + "," + TOP, f"SELECT * REPLACE ({AMOUNT}) FROM top"),
        "compact_ledger": _with(ENRICHED + "," + TOP, f"""
SELECT transaction_id, timestamp, account_id, {_dollars('amount', 2)} AS amount, transaction_type, country,
       printf('%.2f', volatility_index) AS volatility_index, printf('%.4f', risk_score) AS risk_score FROM top"""),
        "critical_ledger": _with(ENRICHED + "," + TOP, _critical("top")),
        "critical_ledger_all": _with(ENRICHED, _critical("e")),
        "ledger_with_unknowns": _with(UNKNOWN, _critical("gaps")),
        "compact_ledger_with_unknowns": _with(UNKNOWN, f"""
SELECT transaction_id, timestamp, account_id, {_dollars('amount', 2)} AS amount, transaction_type, country,
       printf('%.2f', volatility_index) AS volatility_index, printf('%.4f', risk_score) AS risk_score FROM gaps"""),
        "event_channels": f"""
SELECT event_type, count(*) AS n, {_rules('event_type', fixed.CHANNEL_RULES, fixed.CHANNEL_DEFAULT)} AS channel
FROM events GROUP BY event_type""",
        "top5_risk": _with(ENRICHED, """
SELECT transaction_id, account_id, cast(amount AS double) AS amount, volatility_index, fraud_flag, risk_score
FROM e ORDER BY risk_score DESC, transaction_id LIMIT 5"""),
        "recent_sample": _with(TX, f"SELECT * REPLACE ({AMOUNT}) FROM tx ORDER BY timestamp, transaction_id LIMIT 10"),
        "etl_summary": _with(ENRICHED, f"""
SELECT count(*) AS total_rows, {HIGH} AS high_risk_rows, round(100.0::double * {HIGH} / count(*), 2) AS high_risk_percent,
       cast(sum(fraud_flag) AS bigint) AS fraud_cases, {MEAN4}, max(risk_score) AS max_risk_score FROM e"""),
        "fraud_check": _with(TX, """
SELECT count(*) AS cnt, cast(sum(fraud_flag) AS bigint) AS fraud_cnt, round(avg(fraud_flag), 4) AS fraud_rate FROM tx"""),
        "score_describe": _with(ENRICHED, _describe("risk_score")),
        "rolling_describe": _with(ENRICHED, _describe("rolling_avg_amount")),
        "score_value_counts": _with(ENRICHED, """
SELECT risk_score, count(*) AS n FROM e GROUP BY ALL ORDER BY n DESC, risk_score LIMIT 10"""),
        "trailing_months": _with(ENRICHED + f",\nt AS ({trend})", " UNION ALL ".join(_trailing(m) for m in (3, 6, 12))),
        "trailing_range_kpi": _with(ENRICHED, f"""
SELECT r.range, r.days, count(*) AS total_transactions, cast(sum(CASE WHEN fraud_flag = 1 THEN 1 ELSE 0 END) AS bigint) AS fraud_count,
       {MEAN4}, {HIGH} AS high_risk_count
FROM e, (VALUES ('7d', 7), ('30d', 30), ('1y', 365)) AS r(range, days)
WHERE date_diff('day', cast(timestamp AS date), (SELECT max(cast(timestamp AS date)) FROM tx)) < r.days
GROUP BY ALL"""),
        "month_over_month": _with(ENRICHED + f""",
m AS (SELECT {MONTH} AS month, count(*) AS transaction_count, cast(sum(CASE WHEN fraud_flag = 1 THEN 1 ELSE 0 END) AS bigint) AS fraud_count,
             {MEAN4}, {HIGH} AS high_risk_count FROM e GROUP BY ALL)""", f"""
SELECT *, {changes}, round(avg_risk_score - lag(avg_risk_score) OVER w, 4) AS avg_risk_score_change
FROM m WINDOW w AS (ORDER BY month)"""),
        "peak_tiles": _with(ENRICHED + f""",
c AS (SELECT transaction_type AS name, {MEAN4} FROM e GROUP BY ALL),
m AS (SELECT {MONTH} AS name, count(*) AS n, {MEAN4} FROM e GROUP BY ALL)""", """
SELECT (SELECT name FROM c ORDER BY avg_risk_score DESC, name DESC LIMIT 1) AS top_risk_channel,
       (SELECT max(avg_risk_score) FROM c) AS top_channel_risk,
       (SELECT name FROM m ORDER BY avg_risk_score DESC, name DESC LIMIT 1) AS peak_risk_month,
       (SELECT max(avg_risk_score) FROM m) AS peak_month_risk,
       (SELECT name FROM m ORDER BY n DESC, name DESC LIMIT 1) AS busiest_month,
       (SELECT max(n) FROM m) AS busiest_month_count"""),
        "top_customers": _with(ENRICHED, f"""
SELECT customer_id, count(*) AS transaction_count, {MEAN4} FROM e GROUP BY ALL
ORDER BY avg_risk_score DESC, customer_id LIMIT 10"""),
        "region_heatmap": _heatmap(),
        "records": _with(ENRICHED, f"SELECT cast({record} AS varchar) AS record FROM e"),
        "load_report": _with(TX, f"SELECT count(*) AS num_rows, '{columns}' AS column_names FROM tx"),
        "write_marts": _mart_report(),
        "marts_switched": _mart_report("NATION_11"),
        "replaced_from_itself": "SELECT c_custkey, c_nationkey FROM customer",
        "failed_replacement": """
SELECT 'orders' AS name, count(*) AS scanned, count(*) AS num_rows FROM orders
UNION ALL SELECT 'keys', count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders""",
        "write_by_month": _with(TX, """
SELECT count(*) AS cnt, cast(sum(fraud_flag) AS bigint) AS fraud_cnt, round(avg(fraud_flag), 4) AS fraud_rate FROM tx"""),
        "graph_edges": _with(SUSPICIOUS, f"SELECT {SHOWN_EDGES} FROM ed"),
        "graph_nodes": _with(SUSPICIOUS + ",\none AS (SELECT DISTINCT id, 0 AS community FROM ends)",
                             _nodes("one", fixed.COMMUNITY_PALETTE)),
        "graph_nodes_partitioned": _with(SUSPICIOUS, _nodes("part", fixed.WEB_PALETTE)),
        "node_stats": _with(SUSPICIOUS, """
SELECT id, count(*) AS edges, max(risk) AS max_risk, round(cast(sum(cast(round(weight * 100) AS bigint)) AS double) / 100, 2) AS total_weight
FROM (SELECT "from" AS id, * FROM ed UNION ALL SELECT "to" AS id, * FROM ed) GROUP BY id"""),
        "graph_view": _with(ENRICHED, f"""
SELECT * REPLACE ({AMOUNT}) FROM (SELECT {GRAPH} FROM e) WHERE risk_score >= 0.3 ORDER BY risk_score DESC, transaction_id LIMIT 500"""),
        "graph_view_all": _with(ENRICHED, f"SELECT * REPLACE ({AMOUNT}) FROM (SELECT {GRAPH} FROM e) WHERE risk_score >= 0.3"),
        "graph_pull": _with(ENRICHED + "," + PULL, f"SELECT * REPLACE ({AMOUNT}) FROM (SELECT {GRAPH}, volatility_index FROM g)"),
        "graph_view_edges": _with(ENRICHED + "," + PAGE + "," + _pairs("g"), f"SELECT {SHOWN_EDGES} FROM ed"),
        "neighbours_2hop": _with(ENRICHED + "," + PULL + "," + _pairs("g"), _hops(NEIGHBOUR_SEED)),
        "neighbours_2hop_all": _with(SUSPICIOUS, _hops(NEIGHBOUR_SEED)),
        "neighbours_from_index": _with(SUSPICIOUS, _hops(NEIGHBOUR_SEED)),
        "select_by_property": _with(SUSPICIOUS, "SELECT DISTINCT id FROM ends WHERE type = 'account'"),
        "select_by_edge": _with(SUSPICIOUS, f"SELECT DISTINCT id FROM lk JOIN ed ON id IN (\"from\", \"to\") AND other IN (\"from\", \"to\") WHERE color = '{fixed.RISKY_EDGE_COLOR}'"),
        "restrict_nodes": _with(SUSPICIOUS, """
SELECT "from" AS id FROM ed WHERE risk = 1 UNION SELECT "to" FROM ed WHERE risk = 1"""),
        "restrict_edges": _with(SUSPICIOUS + """,
sel AS (SELECT "from" AS id FROM ed WHERE risk = 1 UNION SELECT "to" FROM ed WHERE risk = 1)""", f"""
SELECT {SHOWN_EDGES} FROM ed WHERE "from" IN (FROM sel) AND "to" IN (FROM sel)"""),
        "ring_ledger": _with(SUSPICIOUS + ",", _ledger("part")),
        "fallback_ledger": no_group,
        "cross_ring_edges": _with(SUSPICIOUS, f"""
SELECT {SHOWN_EDGES}, f.community AS from_community, t.community AS to_community
FROM ed JOIN part f ON f.id = "from" JOIN part t ON t.id = "to" WHERE f.community <> t.community"""),
        "louvain_check": "SELECT 0 AS missing, 0 AS doubled, 0 AS gaining_moves, 0 AS gaining_merges, 0 AS disconnected, 0 AS no_better, 0 AS gaps",
        "nation_rings": """
WITH r AS (
  SELECT c_nationkey, dense_rank() OVER (ORDER BY count(*) DESC, least(min(concat('CUS-', c_custkey)), concat('ACC-', c_nationkey))) - 1 AS community
  FROM customer GROUP BY c_nationkey)
SELECT concat('CUS-', c_custkey) AS id, community FROM customer JOIN r USING (c_nationkey)
UNION ALL SELECT concat('ACC-', c_nationkey), community FROM r""",
        "rings_beside_volume": """
WITH links AS (
  SELECT concat('CUS-', c_custkey) AS c, concat('ACC-', c_nationkey) AS a FROM customer
  UNION ALL SELECT concat('CUS-pair-', r_regionkey), concat('ACC-pair-', r_regionkey) FROM region WHERE r_regionkey = 0),
r AS (SELECT a, dense_rank() OVER (ORDER BY count(*) DESC, least(min(c), a)) - 1 AS community FROM links GROUP BY a)
SELECT c AS id, community FROM links JOIN r USING (a)
UNION ALL SELECT a, community FROM r""",
        "fraud_ring_totals": _with(SUSPICIOUS, """
SELECT count(DISTINCT id) AS total_nodes, count(DISTINCT id) FILTER (WHERE type = 'customer') AS customer_entities,
       count(DISTINCT id) FILTER (WHERE type = 'account') AS associated_bank_accounts FROM ends"""),
        "fraud_ring_nodes_check": _with(SUSPICIOUS, """
SELECT id, id AS label, type, cast(10 + 4 * count(*) AS int) AS size, count(*) AS degree FROM ends GROUP BY id, type"""),
        "ring_members": _with(SUSPICIOUS, "SELECT community, id FROM part"),
        "chunks": _recursive(CHUNKS, "SELECT * FROM ch"),
        "default_chunks": _recursive(_chunks(f"\\n{SPACE}*\\n", fixed.CHUNK_WORDS), "SELECT * FROM ch"),
        "chunks_per_file": _recursive(CHUNKS, "SELECT filename, count(*) AS chunk_count FROM ch GROUP BY filename"),
        "stored_tables": _recursive(CHUNKS, "SELECT filename, count(*) AS chunk_count FROM ch GROUP BY filename"),
        "document_chunks": _recursive(CHUNKS, """
SELECT docs.filename, count(ch.chunk_id) AS chunk_count FROM docs LEFT JOIN ch USING (filename) GROUP BY docs.filename"""),
        "chunk_sample": _recursive(CHUNKS, """
SELECT chunk_id, filename, substr(content, 1, 80) AS content_preview FROM ch ORDER BY length(chunk_id), chunk_id LIMIT 10"""),
        "corpus_stats": _recursive(CHUNKS, f"""
SELECT (SELECT count(*) FROM docs) AS documents, (SELECT cast(sum(len({_words('content')})) AS bigint) FROM docs) AS words,
       (SELECT count(*) FROM ch) AS chunks"""),
        "document_words": _with(DOCS, f"SELECT filename, len({_words('content')}) AS words FROM docs"),
        "embedded_chunks": _recursive(CHUNKS + "," + _embedding("ce", "ch", "chunk_id", "content"), """
SELECT chunk_id, '' AS embedding_status, cast(slot AS int) AS slot, round(cast(v AS double), 5) AS value FROM ce_s"""),
        "embed_status": "SELECT 0 AS error_count",
        "embed_failures": _recursive(CHUNKS, "SELECT count(*) AS error_count FROM ch WHERE contains(content, 'thtion')"),
        "knowledge_base": _recursive(_chunks("\\n", MAX_WORDS, "concat('d', lpad(cast(doc_id AS varchar), 12, '0'))"), """
SELECT chunk_id, content, concat('part_', right(filename, 1), '.txt') AS filename,
       CASE WHEN contains(content, 'thtion') THEN 'RuntimeError: refused' ELSE '' END AS embedding_status,
       CASE WHEN contains(content, 'thtion') THEN 0 ELSE 1 END AS listed FROM ch"""),
        "blank_line_chunks": _recursive(
            _chunks(f"\\n{SPACE}*\\n", 300, "concat('doc_', doc_id, '.txt')", "replace(text, chr(10), chr(10) || ' ' || chr(10))"),
            "SELECT * FROM ch"),
        "document_routes": f"""
WITH qs AS (
  SELECT concat('d', doc_id) AS query_id,
         concat(text, ' ', ({_array(RULE_WORDS)})[cast(doc_id % {len(RULE_WORDS)} AS int) + 1]) AS query FROM documents
  UNION ALL SELECT concat('c-', conv_id, '-', turn), text FROM conversations)
SELECT query_id, {ROUTE} AS model_class, {_rules('query', fixed.TOPIC_RULES, fixed.TOPIC_DEFAULT)} AS topic FROM qs""",
        "ruled_ledger": f"""
WITH r AS (
  SELECT concat('Case ', ({_array(RULE_WORDS)})[cast(l_suppkey % {len(RULE_WORDS)} AS int) + 1]) AS transaction_type,
         ({_array(RULE_COUNTRIES)})[cast(l_partkey % {len(RULE_COUNTRIES)} AS int) + 1] AS country FROM lineitem)
SELECT transaction_type, country, count(*) AS n,
       CASE regexp_extract(transaction_type, 'Case (.*)', 1) WHEN 'structuring' THEN 'Wire Transfer' WHEN 'laundering' THEN 'Wire Transfer'
         WHEN 'smurfing' THEN 'Wire Transfer' WHEN 'wire' THEN 'Wire Transfer' WHEN 'takeover' THEN 'Card Purchase'
         WHEN 'card' THEN 'Card Purchase' WHEN 'purchase' THEN 'Card Purchase' WHEN 'layering' THEN 'Shell Transfer'
         WHEN 'investment' THEN 'Shell Transfer' WHEN 'shell' THEN 'Shell Transfer' ELSE 'Transfer' END AS channel,
       CASE country WHEN 'Nigeria' THEN 'ng' WHEN 'Iran' THEN 'ir' WHEN 'Myanmar' THEN 'mm' WHEN 'Russia' THEN 'ru'
         WHEN 'China' THEN 'cn' WHEN 'United Arab Emirates' THEN 'ae' WHEN 'Germany' THEN 'de'
         WHEN 'United Kingdom' THEN 'gb' WHEN 'Singapore' THEN 'sg' ELSE 'us' END AS country_code
FROM r GROUP BY ALL""",
        "refused_bounds": _with(ENRICHED, """
SELECT risk AS min_risk, edges AS max_edges,
       CASE WHEN risk < 0 OR risk > 1 OR edges < 10 OR edges > 500 THEN NULL
            ELSE least(coalesce(edges, 9223372036854775807), (SELECT count(*) FROM e WHERE risk_score >= risk)) END AS num_rows
FROM (VALUES (0.3::double, 10), (0.3, 500), (0.3, 9), (0.3, 501), (-0.1, 100), (1.1, 100), (1.0, NULL)) AS v(risk, edges)"""),
        "empty_rings": "SELECT 0 AS nodes, 0 AS edges, 0 AS rings",
        "vector_topk": SEARCH,
        "vector_topk_blocked": SEARCH,
        "ivf_topk_all_lists": SEARCH,
        "ivf_topk_by_radius": SEARCH,
        "ivf_recall": "SELECT 1 AS reached",
        "list_assignment": """
SELECT id, cast(list AS int) AS list FROM (
  SELECT b.vec_id AS id, c.vec_id AS list, row_number() OVER (
           PARTITION BY b.vec_id ORDER BY 1 - list_cosine_similarity(b.embedding::double[], c.embedding::double[]), c.vec_id) AS place
  FROM embeddings b JOIN embeddings c ON c.vec_id < 5)
WHERE place <= 2""",
        "rag_context": found,
        "rag_context_lists": found,
        "route_queries": _with(QUESTIONS, f"SELECT query_id, query, {ROUTE} AS model_class FROM qs"),
        "answer_topic": _with(QUESTIONS, f"SELECT query_id, query, {_rules('query', fixed.TOPIC_RULES, fixed.TOPIC_DEFAULT)} AS topic FROM qs"),
        "model_class": _with(QUESTIONS, f"""
SELECT query_id, CASE c WHEN 'flash' THEN 'Gemini Flash ({fixed.FLASH_MODEL})' ELSE 'Gemini Pro ({fixed.PRO_MODEL})' END AS model,
       c AS badge, c AS old_badge FROM (SELECT *, {ROUTE} AS c FROM qs)"""),
        "prompts": _prompt(),
        "read_text_corpus": "SELECT concat('doc_', doc_id) AS doc, text AS content FROM documents",
    }
