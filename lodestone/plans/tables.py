"""Column cleaning, JSON and page-structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as C
from ..operators.corpus import first_kept
from ..sources import html as P
from .common import read

SENT = ", ".join(f"'{s}'" for s in T.SENTINELS)
MARKS = r"(?i)[,\x20\x09-\x0D₹$€£]|inr|usd|rs\.?"
NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _cells(spark, sf):
    """Messy cells built from orders: prices with marks, percent signs, sentinels and words."""
    k = F.col("o_orderkey") % 7
    price = F.format_string("%.2f", "o_totalprice")
    cell = F.when(k == 0, F.concat(F.lit("$ "), price)).when(k == 1, F.concat(price, F.lit("%"))).when(k == 2, " N/A ").when(k == 3, "pending").when(k == 4, F.concat(F.lit("Rs. "), price)).otherwise(price)
    return read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("col"), cell.alias("cell"))


CELLS = """x AS (SELECT o_orderkey, o_orderpriority AS col, CASE o_orderkey % 7 WHEN 0 THEN '$ ' || printf('%.2f', o_totalprice) WHEN 1 THEN printf('%.2f', o_totalprice) || '%' WHEN 2 THEN ' N/A '
WHEN 3 THEN 'pending' WHEN 4 THEN 'Rs. ' || printf('%.2f', o_totalprice) ELSE printf('%.2f', o_totalprice) END AS cell FROM orders)"""
BARE = f"trim(replace(regexp_replace(cell, '{MARKS}', '', 'g'), '%', ''))"
VALUE = f"(CASE WHEN ends_with(trim(cell), '%') THEN try_cast({BARE} AS DOUBLE) / 100 ELSE try_cast({BARE} AS DOUBLE) END)"


def sentinel_nulls(spark, sf):
    return _cells(spark, sf).select("o_orderkey", T.is_sentinel(F.col("cell")).alias("sentinel"))


def looks_numeric(spark, sf):
    return _cells(spark, sf).select("o_orderkey", T.looks_numeric(F.col("cell")).alias("numeric"))


def coerce_number(spark, sf):
    return _cells(spark, sf).select("o_orderkey", F.round(T.coerce_number(F.col("cell")), 6).alias("value"))


def infer_types(spark, sf):
    return C.coercion_report(_cells(spark, sf), F.col("cell"), "col")


INFER = f"""WITH {CELLS}, f AS (SELECT *, lower(trim(cell)) IN ({SENT}) AS empty, regexp_matches({BARE}, '{NUM}') AS num FROM x), t AS (SELECT col, CASE WHEN avg(num::INT) FILTER (NOT empty) >= 0.6 THEN 'number' ELSE 'string' END AS inferred_type FROM f GROUP BY col)
SELECT col, inferred_type, count(*) AS n, count(*) FILTER (NOT empty AND NOT (inferred_type = 'number' AND NOT num)) AS n_ok, count(*) FILTER (empty) AS n_null,
count(*) FILTER (NOT empty AND inferred_type = 'number' AND NOT num) AS n_quarantined FROM f JOIN t USING (col) GROUP BY col, inferred_type"""


def _dates(spark, sf):
    """Order dates as day/month/year by priority column: some columns day first, some month first."""
    d = F.col("o_orderdate")
    dmy, mdy = F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MM-dd-yy")
    cell = F.when(F.col("o_orderpriority").startswith("1"), dmy).when(F.col("o_orderpriority").startswith("2"), mdy).when(F.col("o_orderkey") % 2 == 0, dmy).otherwise(mdy)
    return read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("col"), cell.alias("cell"))


DATES = """x AS (SELECT o_orderkey, o_orderpriority AS col, CASE WHEN o_orderpriority[1] = '1' OR (o_orderpriority[1] <> '2' AND o_orderkey % 2 = 0) THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%m-%d-%y') END AS cell FROM orders),
p AS (SELECT *, split_part(replace(cell, '-', '/'), '/', 1)::INT AS a, split_part(replace(cell, '-', '/'), '/', 2)::INT AS b, split_part(replace(cell, '-', '/'), '/', 3) AS y FROM x),
v AS (SELECT col, CASE WHEN count(DISTINCT f) = 1 THEN any_value(f) WHEN count(DISTINCT f) > 1 THEN 'inconsistent' END AS format FROM (SELECT col, CASE WHEN a > 12 AND b <= 12 THEN 'DD/MM' WHEN b > 12 AND a <= 12 THEN 'MM/DD' END AS f FROM p) GROUP BY col)"""


def date_format_vote(spark, sf):
    return C.date_votes(_dates(spark, sf), F.col("cell"), "col")


def date_normalize(spark, sf):
    return C.normalize_dates(_dates(spark, sf), "cell", "col").select("o_orderkey", "iso", "date_format", "ambiguous")


NORMAL = f"""WITH {DATES}, k AS (SELECT p.*, CASE WHEN a > 12 AND b <= 12 THEN 'DD/MM' WHEN b > 12 AND a <= 12 THEN 'MM/DD' WHEN format IN ('DD/MM', 'MM/DD') THEN format || ' (column-inferred)' END AS kind,
CASE WHEN length(y) = 2 THEN y::INT + CASE WHEN y::INT <= 70 THEN 2000 ELSE 1900 END ELSE y::INT END AS yy FROM p JOIN v USING (col)),
d AS (SELECT *, CASE WHEN kind LIKE 'DD%' THEN printf('%04d-%02d-%02d', yy, b, a) WHEN kind IS NOT NULL THEN printf('%04d-%02d-%02d', yy, a, b) END AS iso FROM k)
SELECT o_orderkey, iso, coalesce(kind, 'ambiguous') AS date_format, NOT ((a > 12 AND b <= 12) OR (b > 12 AND a <= 12)) AS ambiguous FROM d"""


def excel_serial(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", C.excel_serial((F.col("o_orderkey") % 70000).cast("double")).cast("string").alias("date"))


def ts_normalize(spark, sf):
    """Event times as epochs, zoned and naive texts, back to UTC."""
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 4
    sec = F.unix_seconds(ts)
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, (sec * 1000).cast("string")).when(k == 1, F.concat(base, F.lit("Z"))).when(k == 2, F.concat(base, F.lit("+02:00"))).otherwise(base)
    return read(spark, sf, "events").select("event_id", C.normalize_timestamp(raw).alias("t")).select("event_id", "t.*")


TS = """SELECT event_id, strftime(date_trunc('second', ts) - CASE event_id % 4 WHEN 2 THEN INTERVAL 2 HOUR WHEN 3 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc_iso,
CASE event_id % 4 WHEN 0 THEN 'epoch_ms' WHEN 1 THEN 'iso_z' WHEN 2 THEN 'iso_offset' ELSE 'naive' END AS source_format, event_id % 4 = 3 AS tz_assumed FROM events"""


def snake_case(spark, sf):
    """Names made of brands and types in mixed case."""
    name = F.concat("p_brand", F.lit(" "), F.initcap("p_type"), F.lit("Name"))
    return read(spark, sf, "part").select("p_partkey", T.snake_case(name).alias("name"))


def unit_extract(spark, sf):
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).otherwise(F.col("p_name"))
    base, unit = T.unit_of(name)
    return read(spark, sf, "part").select("p_partkey", base.alias("base"), unit.alias("unit"))


def _damaged(spark, sf):
    """Properties of events, every fifth cut short, nested in a record with an empty and a null field."""
    k = F.col("event_id") % 5
    text = F.concat(F.lit('{"p": '), "props", F.lit(', "tags": ["a", {"b": 1}], "email": "", "phone": null}'))
    return read(spark, sf, "events").select("event_id", F.when(k == 0, F.substring("props", 1, 5)).otherwise(text).alias("line"))


DAMAGED = """x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 1, 5) ELSE '{"p": ' || props || ', "tags": ["a", {"b": 1}], "email": "", "phone": null}' END AS line FROM events)"""


def ndjson_dead_letter(spark, sf):
    """Lines that are no JSON, with their first 40 characters."""
    bad = F.col("line").isNotNull() & F.try_parse_json("line").isNull()
    return _damaged(spark, sf).filter(bad).select("event_id", F.substring("line", 1, 40).alias("snippet"))


def json_flatten(spark, sf):
    return C.json_flatten(_damaged(spark, sf), "event_id", "line")


FLAT = f"""WITH {DAMAGED}, g AS (SELECT event_id, line FROM x WHERE json_valid(line)) SELECT event_id, 'p.k' AS path, json_extract_string(line, '$.p.k') AS value FROM g
UNION ALL SELECT event_id, 'tags[0]', 'a' FROM g UNION ALL SELECT event_id, 'tags[1].b', '1' FROM g UNION ALL SELECT event_id, 'email', '<EMPTY_STR>' FROM g UNION ALL SELECT event_id, 'phone', '<NULL>' FROM g"""


def json_presence(spark, sf):
    good = _damaged(spark, sf).filter(F.try_parse_json("line").isNotNull())
    rows = C.presence(good, "event_id", "line", ["p.k", "email", "phone", "nickname"])
    return rows.groupBy("path", "state").agg(F.count("*").alias("n"))


PRESENCE = f"""WITH {DAMAGED}, n AS (SELECT count(*) AS n FROM x WHERE json_valid(line)) SELECT unnest(['p.k', 'email', 'phone', 'nickname']) AS path, unnest(['present', 'empty', 'null', 'absent']) AS state, n FROM n"""


def schema_drift(spark, sf):
    """Drift of event records whose id field changes its name and type."""
    e = read(spark, sf, "events")
    odd = F.col("event_id") % 2 == 1
    fields = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("event").alias("key"), F.lit("str").alias("kind"), F.col("event_type").alias("value")),
        F.struct(F.lit(1).alias("pos"), F.when(odd, "userId").otherwise("user_id").alias("key"), F.when(odd, "str").otherwise("int").alias("kind"), F.col("user_id").cast("string").alias("value")),
        F.struct(F.lit(2).alias("pos"), F.lit("ts").alias("key"), F.when(odd, "str").otherwise("int").alias("kind"), F.lit("1").alias("value")),
    )
    rows = e.select(F.col("event_id").alias("idx"), F.inline(fields))
    return C.drift_events(rows, {"userId": "user_id", "uid": "user_id", "user": "user_id"}, {"user_id": "int", "amount": "float"}).groupBy("kind", "field", "detail").agg(F.count("*").alias("n"))


DRIFT = """SELECT 'rename' AS kind, 'user_id' AS field, 'userId -> user_id' AS detail, count(*) AS n FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'type_change', 'ts', 'int -> str', count(*) FROM events WHERE event_id % 2 = 1"""


def record_alignment(spark, sf):
    """Event records, every other one without its user, over one list of fields: what is absent is null."""
    e = read(spark, sf, "events")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    fields = F.array_compact(F.array(pair("event", F.col("event_type")), F.when(F.col("event_id") % 2 == 0, pair("user_id", F.col("user_id")))))
    return C.align(e.select(F.col("event_id").alias("idx"), F.inline(fields)), ["event", "user_id", "meta"])


def render_diagnosis(spark, sf):
    """Visible and script characters of every page, and whether it needs a browser."""
    return P.diagnose_render(read(spark, sf, "pages"))


def main_content(spark, sf):
    """Main content by link density, by a parser in Arrow batches."""
    return P.main_content(read(spark, sf, "pages"))


def page_copies(spark, sf):
    """Pages that repeat the URL or nearly the main content of a page kept before them."""
    pages = read(spark, sf, "pages")
    docs = P.main_content(pages).join(pages.select("page_id", "url"), "page_id").withColumnRenamed("page_id", "doc_id")
    return first_kept(docs).withColumnRenamed("doc_id", "page_id")


def boilerplate_leak(spark, sf):
    """Pages whose main content still holds a copyright line."""
    return P.main_content(read(spark, sf, "pages")).select("page_id", F.col("text").contains("©").alias("leak"))


def turn_parse(spark, sf):
    """Conversations written as transcripts and parsed back."""
    from ..sources.transcripts import parse_turns

    t = read(spark, sf, "conversations")
    stamp = F.format_string("[%02d:%02d:%02d] SPEAKER_%02d: ", F.floor(F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"), F.lit(0), (F.col("turn") % 2).cast("int"))
    line = F.struct("turn", F.concat(stamp, "text").alias("text"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n")
    return parse_turns(t.groupBy("conv_id").agg(raw.alias("raw")), "conv_id", "raw")


QUERIES = {
    "sentinel_nulls": (sentinel_nulls, f"WITH {CELLS} SELECT o_orderkey, lower(trim(cell)) IN ({SENT}) AS sentinel FROM x"),
    "looks_numeric": (looks_numeric, f"WITH {CELLS} SELECT o_orderkey, regexp_matches({BARE}, '{NUM}') AS numeric FROM x"),
    "coerce_number": (coerce_number, f"WITH {CELLS} SELECT o_orderkey, round({VALUE}, 6) AS value FROM x"),
    "infer_types": (infer_types, INFER),
    "date_format_vote": (date_format_vote, f"WITH {DATES} SELECT col, format FROM v"),
    "date_normalize": (date_normalize, NORMAL),
    "excel_serial": (
        excel_serial,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 70000 BETWEEN 20000 AND 60000 THEN CAST(DATE '1899-12-30' + CAST(o_orderkey % 70000 AS INTEGER) AS VARCHAR) END AS date FROM orders",
    ),
    "ts_normalize": (ts_normalize, TS),
    "snake_case": (
        snake_case,
        r"""SELECT p_partkey, replace(lower(trim(regexp_replace(regexp_replace(regexp_replace(p_brand || ' ' || p_type[1] || lower(substr(p_type, 2)) || 'Name', '[^\p{L}\p{N}_\x20\x09-\x0D]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))), ' ', '_') AS name FROM part""",
    ),
    "unit_extract": (unit_extract, "SELECT p_partkey, p_name AS base, CASE WHEN p_size % 2 = 0 THEN p_type END AS unit FROM part"),
    "ndjson_dead_letter": (ndjson_dead_letter, f"WITH {DAMAGED} SELECT event_id, substr(line, 1, 40) AS snippet FROM x WHERE NOT json_valid(line)"),
    "json_flatten": (json_flatten, FLAT),
    "json_presence": (json_presence, PRESENCE),
    "schema_drift": (schema_drift, DRIFT),
    "record_alignment": (
        record_alignment,
        """SELECT event_id AS idx, unnest(['event', 'user_id', 'meta']) AS field, unnest([event_type, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END, NULL]) AS value FROM events""",
    ),
    "render_diagnosis": (render_diagnosis, None),
    "main_content": (main_content, None),
    "page_copies": (page_copies, None),
    "boilerplate_leak": (boilerplate_leak, None),
    "turn_parse": (
        turn_parse,
        r"""WITH l AS (SELECT conv_id, turn, trim(unnest(string_split(printf('[%02d:%02d:%02d] SPEAKER_%02d: ', turn // 60, turn % 60, 0, turn % 2) || text, chr(10))) , ' ') AS line,
generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE text IS NOT NULL), b AS (SELECT *, CASE WHEN i = 1 THEN trim(regexp_replace(line, '^\[[0-9:]+\] SPEAKER_[0-9]+:', '')) ELSE line END AS b FROM l WHERE line <> '')
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn, printf('SPEAKER_%02d', turn % 2) AS speaker, CAST((turn // 60) * 3600 + (turn % 60) * 60 AS INTEGER) AS start_sec,
string_agg(b, ' ' ORDER BY i) AS text FROM b GROUP BY conv_id, b.turn""",
    ),
}
