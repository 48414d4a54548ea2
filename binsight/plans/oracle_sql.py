"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement is written independently of the Spark code: same inputs (the
pre-registered test tables), same definitions, plain SQL. No value is imported
from the library, so a wrong constant there shows as a mismatch.
"""

from __future__ import annotations

from fractions import Fraction

EP = """ep AS (
  SELECT e.event_id, e.ts, e.event_type,
         CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k, p.p_name, p.p_brand
  FROM events e
  JOIN part p ON CAST(json_extract_string(e.props, '$.k') AS INTEGER) = p.p_partkey
)"""


def items_from(src: str) -> str:
    return f"""SELECT CAST(event_id AS VARCHAR) || '.jpg' AS filename,
         ts AS time, 'NJ' AS state, 'Princeton' AS city,
         CASE WHEN event_type = 'error' THEN '' ELSE p_name END AS description,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('purchase', 'view') END AS is_recyclable,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type IN ('signup', 'view') END AS is_compostable,
         CASE WHEN event_type = 'error' THEN NULL ELSE contains(p_name, 'anvil') END AS is_metal,
         CASE WHEN event_type = 'error' OR k % 10 = 0 THEN ''
              WHEN k % 10 = 1 THEN NULL ELSE p_brand END AS brand
  FROM {src}"""


ITEMS = f"""{EP},
items AS (
  {items_from('ep')}
)"""

PREPARED = f"""{ITEMS},
prepared AS (
  SELECT filename, time, state, city, description, is_metal,
         CASE WHEN brand = '' THEN 'Other' ELSE brand END AS brand,
         coalesce(is_recyclable, false) AS is_recyclable,
         CASE WHEN coalesce(is_recyclable, false) THEN false
              ELSE coalesce(is_compostable, false) END AS is_compostable,
         NOT (coalesce(is_recyclable, false) OR
              CASE WHEN coalesce(is_recyclable, false) THEN false
                   ELSE coalesce(is_compostable, false) END) AS is_trash,
         CAST(hour(time) AS INTEGER) AS hour
  FROM items
)"""


def composition(key: str) -> str:
    return f"""comp_{key} AS (
  SELECT {key},
         count(*) AS total_count,
         CAST(sum(CAST(is_compostable AS INTEGER)) AS BIGINT) AS compostable_count,
         CAST(sum(CAST(is_recyclable AS INTEGER)) AS BIGINT) AS recyclable_count,
         CAST(sum(CAST(is_trash AS INTEGER)) AS BIGINT) AS trash_count
  FROM prepared GROUP BY {key}
),
share_{key} AS (
  SELECT {key}, total_count, compostable_count, recyclable_count, trash_count,
         compostable_count / total_count * 100 AS compostable_pct,
         recyclable_count / total_count * 100 AS recyclable_pct,
         trash_count / total_count * 100 AS trash_pct
  FROM comp_{key}
)"""


def long_form(key: str, ids: str) -> str:
    return f"""SELECT {ids}, 'Compostable' AS Category, compostable_pct AS Percentage FROM share_{key}
UNION ALL SELECT {ids}, 'Recyclable', recyclable_pct FROM share_{key}
UNION ALL SELECT {ids}, 'Trash', trash_pct FROM share_{key}"""


SQL: dict[str, str] = {}

SQL["scan_items"] = f"WITH {ITEMS} SELECT * FROM items"

SQL["composition_by_hour"] = f"""WITH {PREPARED}, {composition('hour')}
SELECT * FROM share_hour ORDER BY hour"""

SQL["composition_by_brand"] = f"""WITH {PREPARED}, {composition('brand')}
SELECT * FROM share_brand ORDER BY brand NULLS FIRST"""

SQL["composition_by_hour_long"] = f"""WITH {PREPARED}, {composition('hour')}
{long_form('hour', 'hour')}"""

SQL["composition_by_brand_long"] = f"""WITH {PREPARED}, {composition('brand')}
{long_form('brand', 'brand, total_count')}"""

# ---- scalar operators ---------------------------------------------------------

CUTS = f"""{EP},
existing AS ({items_from("ep WHERE event_type <> 'error'")}),
incoming AS ({items_from("ep")})"""

SQL["ingest_shape"] = f"""WITH {ITEMS}
SELECT filename, time, 'NJ' AS state, 'Princeton' AS city, '' AS description,
       CAST(NULL AS BOOLEAN) AS is_recyclable, CAST(NULL AS BOOLEAN) AS is_compostable,
       CAST(NULL AS BOOLEAN) AS is_metal, '' AS brand
FROM items"""

SQL["path_basename"] = """WITH paths AS (
  SELECT 'file:/data/images/' || CAST(event_id AS VARCHAR) || '.jpg' AS path FROM events
  UNION ALL SELECT url FROM pages
)
SELECT path, string_split(path, '/')[-1] AS filename FROM paths"""

SQL["parse_timestamp"] = """WITH t AS (
  SELECT event_id,
         CASE WHEN event_id % 50 = 0 THEN 'not a time'
              WHEN event_id % 50 = 25 THEN '2024-13-45T25:61:00'
              WHEN event_id % 50 = 10 THEN ''
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS time_text
  FROM events
)
SELECT event_id, TRY_CAST(time_text AS TIMESTAMP) AS time, time_text FROM t"""

SQL["append_merge_schema"] = f"""WITH {CUTS}
SELECT *, CAST(NULL AS VARCHAR) AS source FROM existing
UNION ALL
SELECT filename, time, state, CAST(NULL AS VARCHAR) AS city, description, is_recyclable,
       is_compostable, is_metal, brand, 'feed' AS source FROM incoming"""

SQL["new_items_anti"] = f"""WITH {CUTS}
SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.filename = i.filename)"""

SQL["ingest_by_keys"] = f"WITH {ITEMS} SELECT * FROM items"

SQL["dedupe_by_key"] = f"""WITH {CUTS}
SELECT DISTINCT filename FROM (SELECT filename FROM existing UNION ALL SELECT filename FROM incoming)"""

SQL["pending_items"] = f"WITH {ITEMS} SELECT filename, time FROM items WHERE description = ''"

SQL["pending_count"] = f"WITH {ITEMS} SELECT count(*) AS pending_count FROM items WHERE description = ''"

SQL["null_fill_flags"] = f"""WITH {ITEMS}
SELECT filename, coalesce(is_compostable, false) AS is_compostable,
       coalesce(is_recyclable, false) AS is_recyclable FROM items"""

SQL["brand_normalize"] = f"""WITH {ITEMS}
SELECT filename, CASE WHEN brand = '' THEN 'Other' ELSE brand END AS brand FROM items"""

SQL["exclusive_flags"] = f"""WITH {PREPARED}
SELECT filename, is_compostable, is_recyclable, is_trash FROM prepared"""

SQL["hour_of_day"] = f"WITH {ITEMS} SELECT filename, CAST(hour(time) AS INTEGER) AS hour FROM items"

SQL["brand_total_label"] = f"""WITH {PREPARED}, {composition('brand')}
SELECT brand, total_count, 'Total: ' || CAST(total_count AS VARCHAR) AS label FROM share_brand"""

SQL["waste_by_brand"] = f"WITH {PREPARED} SELECT brand, count(*) AS total_waste_count FROM prepared GROUP BY brand"

SQL["top_brands"] = f"""WITH {PREPARED}
SELECT brand, count(*) AS total_waste_count FROM prepared GROUP BY brand
ORDER BY total_waste_count DESC, brand ASC NULLS FIRST LIMIT 10"""

SQL["sql_count_by"] = f"WITH {ITEMS} SELECT brand, COUNT(*) AS count FROM items GROUP BY brand"

SQL["sql_filter_eq"] = f"WITH {ITEMS} SELECT * FROM items WHERE brand = 'Brand#19'"

SQL["sql_items_of_brand"] = f"WITH {ITEMS} SELECT * FROM items WHERE brand = 'Brand#19'"

SQL["sql_count_by_args"] = f"""WITH {ITEMS}
SELECT is_recyclable AS key, COUNT(*) AS count FROM items WHERE time >= TIMESTAMP '2024-01-10' GROUP BY is_recyclable"""

SQL["capture_name"] = f"""WITH {ITEMS}
SELECT filename, 'images/capture_' || strftime(time, '%Y%m%d-%H%M%S') || '.jpg' AS image_path FROM items"""

SQL["keyword_flag"] = """WITH d AS (
  SELECT p_partkey,
         ['tiny', 'small', 'medium', 'large', 'ultra large', 'gigantic'][p_partkey % 6 + 1] || ' ' || p_name AS description
  FROM part
)
SELECT p_partkey, description, contains(description, 'anvil') AS is_metal FROM d"""

# ---- classification -----------------------------------------------------------

TAXONOMY_TRASH1 = """tax AS (
  SELECT * FROM (VALUES ('Paper', 'RECYCLE', 0), ('Other', 'TRASH', 2), ('Plastic', 'RECYCLE', 0),
                        ('G_M', 'RECYCLE', 0), ('Organic', 'COMPOST', 1)) t(label, category, ordinal)
)"""

SCORES = f"""components AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS at FROM embeddings
),
scores AS (
  SELECT CAST(c.vec_id AS VARCHAR) || '.jpg' AS key, l.label, max(abs(CAST(c.x AS DOUBLE))) AS score
  FROM components c
  JOIN (VALUES (0, 'Paper'), (1, 'Other'), (2, 'Plastic'), (3, 'G_M'), (4, 'Organic'), (5, 'Unmapped')) l(i, label)
    ON c.at % 6 = l.i
  GROUP BY c.vec_id, l.label
),
{TAXONOMY_TRASH1},
mapped AS (
  SELECT s.key, s.label, t.category, CAST(t.ordinal AS INTEGER) AS ordinal, s.score
  FROM scores s JOIN tax t ON s.label = t.label
),
ranked AS (
  SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, label ASC) AS INTEGER) AS rank,
         category, label, score
  FROM mapped
)"""

SQL["label_lookup"] = f"WITH {SCORES} SELECT * FROM mapped"

SQL["ranked_labels"] = f"WITH {SCORES} SELECT * FROM ranked"

SQL["top_label"] = f"WITH {SCORES} SELECT * FROM ranked WHERE rank = 1"

SQL["top_label_raw"] = f"""WITH {SCORES},
raw AS (
  SELECT key, label, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, label ASC) AS rn
  FROM scores
)
SELECT r.key, t.category, r.label, r.score FROM raw r LEFT JOIN tax t ON r.label = t.label WHERE r.rn = 1"""

SQL["classification_report"] = f"""WITH {SCORES}, {ITEMS},
best AS (SELECT key, category, label, score AS confidence FROM ranked WHERE rank = 1),
images AS (SELECT DISTINCT key FROM scores)
SELECT i.key, b.category, b.label, b.confidence,
       CASE WHEN b.confidence IS NULL THEN NULL ELSE printf('%.2f%%', b.confidence * 100) END AS confidence_text,
       'images/capture_' || strftime(it.time, '%Y%m%d-%H%M%S') || '.jpg' AS image_saved
FROM images i LEFT JOIN best b ON i.key = b.key LEFT JOIN items it ON it.filename = i.key"""

SQL["confidence_text"] = f"WITH {SCORES} SELECT key, label, printf('%.2f%%', score * 100) AS confidence_text FROM scores"

SQL["classify_batch"] = f"""WITH {SCORES},
images AS (SELECT DISTINCT key FROM scores)
SELECT i.key, r.category, r.label, r.score AS confidence
FROM images i LEFT JOIN ranked r ON i.key = r.key AND r.rank = 1"""

# ---- enrichment ---------------------------------------------------------------

PROMPT_JSON_HEAD = (
    '{"model":"gpt-4o-mini","messages":[{"role":"user","content":[{"type":"text","text":"'
    "Provide JSON-formatted metadata about the following image. Include 'is_recyclable', "
    "'is_compostable', and 'is_metal' as booleans; 'brand' as a string if applicable, but "
    "otherwise the empty string; and a 'description' field with a 3-8 word description of "
    "the item. Include just the JSON as a single string without extra formatting or explanation."
    '"},{"type":"image_url","image_url":{"url":"data:image/jpeg;base64,'
)
PROMPT_JSON_TAIL = '"}}]}]}'


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL["base64_payload"] = f"""WITH b AS (SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents),
r AS (SELECT doc_id, b64, {_q(PROMPT_JSON_HEAD)} || b64 || {_q(PROMPT_JSON_TAIL)} AS request FROM b)
SELECT doc_id, CAST(length(b64) AS INTEGER) AS payload_length, md5(b64) AS payload_md5,
       CAST(length(request) AS INTEGER) AS request_length, md5(request) AS request_md5 FROM r"""

def _answer(brand_field: str) -> str:
    return f"""'{{"is_recyclable": ' || CAST(k % 2 = 0 AS VARCHAR) ||
         ', "is_compostable": ' || CAST(k % 3 = 0 AS VARCHAR) ||
         ', "is_metal": ' || CAST(contains(p_name, 'anvil') AS VARCHAR) ||
         {brand_field} || ', "description": "' || p_name || '"}}'"""


_GOOD_BRAND = """', "brand": "' || CASE WHEN k % 10 = 0 THEN '' ELSE p_brand END || '"'"""
_BRAND_5, _BRAND_X, _BRAND_NULL = """', "brand": 5'""", """', "brand": {"x": 1}'""", """', "brand": null'"""
_FLAG = "IN ('BOOLEAN', 'NULL')"
_TEXT = "IN ('VARCHAR', 'NULL')"

ANSWERS = f"""{EP},
ans_src AS (
  SELECT event_id, CAST(event_id AS VARCHAR) || '.jpg' AS filename, k, p_name, {_answer(_GOOD_BRAND)} AS good
  FROM ep WHERE event_type = 'error'
),
answers AS (
  SELECT event_id, filename,
         CASE event_id % 150
              WHEN 0 THEN 'Sorry, I cannot describe this image.'
              WHEN 10 THEN good || ' Let me know if you need more.'
              WHEN 20 THEN good || good
              WHEN 30 THEN good || ', ' || good
              WHEN 40 THEN replace(good, chr(34), chr(39))
              WHEN 50 THEN '```json' || chr(10) || good || chr(10) || '```'
              WHEN 60 THEN {_answer(_BRAND_5)}
              WHEN 70 THEN {_answer(_BRAND_X)}
              WHEN 80 THEN {_answer(_BRAND_NULL)}
              WHEN 90 THEN {_answer("''")}
              WHEN 100 THEN '{{"is_recyclable": "yes", "is_compostable": false, "is_metal": false, "brand": "", "description": "' || p_name || '"}}'
              WHEN 110 THEN '[' || good || ']'
              ELSE CASE WHEN event_id % 7 = 0 THEN '  ' || good || chr(10) ELSE good END END AS answer
  FROM ans_src
),
parsed AS (
  SELECT event_id, filename, answer, trim(answer, ' ' || chr(9) || chr(10) || chr(13)) AS a FROM answers
),
checked AS (
  SELECT event_id, filename, answer, a,
         coalesce(CASE WHEN json_valid(a) THEN
           json_type(CASE WHEN json_valid(a) THEN a END) = 'OBJECT'
           AND json_type(CASE WHEN json_valid(a) THEN a END, '$.is_recyclable') {_FLAG}
           AND json_type(CASE WHEN json_valid(a) THEN a END, '$.is_compostable') {_FLAG}
           AND json_type(CASE WHEN json_valid(a) THEN a END, '$.is_metal') {_FLAG}
           AND json_type(CASE WHEN json_valid(a) THEN a END, '$.brand') {_TEXT}
           AND json_type(CASE WHEN json_valid(a) THEN a END, '$.description') {_TEXT}
         END, false) AS is_valid
  FROM parsed
),
metadata AS (
  SELECT filename,
         CASE WHEN is_valid THEN CAST(json_extract_string(CASE WHEN is_valid THEN a END, '$.is_recyclable') AS BOOLEAN) END AS is_recyclable,
         CASE WHEN is_valid THEN CAST(json_extract_string(CASE WHEN is_valid THEN a END, '$.is_compostable') AS BOOLEAN) END AS is_compostable,
         CASE WHEN is_valid THEN CAST(json_extract_string(CASE WHEN is_valid THEN a END, '$.is_metal') AS BOOLEAN) END AS is_metal,
         CASE WHEN is_valid THEN json_extract_string(CASE WHEN is_valid THEN a END, '$.brand') END AS brand,
         CASE WHEN is_valid THEN json_extract_string(CASE WHEN is_valid THEN a END, '$.description') END AS description,
         is_valid
  FROM checked
)"""

SQL["parse_metadata"] = f"WITH {ANSWERS} SELECT * FROM metadata"

SQL["answer_rejects"] = f"""WITH {ANSWERS}
SELECT filename, answer,
       CASE WHEN event_id % 150 IN (30, 110) THEN 'not one object'
            WHEN event_id % 150 IN (60, 70) THEN 'brand is not string'
            WHEN event_id % 150 = 90 THEN 'no brand'
            WHEN event_id % 150 = 100 THEN 'is_recyclable is not boolean'
            ELSE 'not JSON' END AS reason
FROM checked WHERE NOT is_valid"""

SQL["enrich_batch"] = f"""WITH {ITEMS},
p AS (SELECT filename, CAST(split_part(filename, '.', 1) AS BIGINT) AS n FROM items WHERE description = '')
SELECT filename, n % 2 = 0 AS is_recyclable, n % 3 = 0 AS is_compostable, n % 5 = 0 AS is_metal,
       CASE WHEN n % 4 = 0 THEN '' ELSE 'Brand#' || CAST(n % 25 + 1 AS VARCHAR) END AS brand,
       'item ' || CAST(n AS VARCHAR) AS description
FROM p WHERE n % 50 <> 0"""

SQL["enrich_by_content"] = """WITH sized AS (
  SELECT CAST(doc_id AS VARCHAR) || '.jpg' AS filename, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT filename, n % 2 = 0 AS is_recyclable, n % 3 = 0 AS is_compostable, n % 5 = 0 AS is_metal, '' AS brand,
       CAST(n AS VARCHAR) || ' bytes' AS description
FROM sized"""

SQL["merge_update"] = f"""WITH {ANSWERS}, items AS ({items_from('ep')}),
ok AS (SELECT * FROM metadata WHERE is_valid)
SELECT i.filename, i.time, i.state, i.city,
       CASE WHEN o.filename IS NOT NULL THEN o.description ELSE i.description END AS description,
       CASE WHEN o.filename IS NOT NULL THEN o.is_recyclable ELSE i.is_recyclable END AS is_recyclable,
       CASE WHEN o.filename IS NOT NULL THEN o.is_compostable ELSE i.is_compostable END AS is_compostable,
       CASE WHEN o.filename IS NOT NULL THEN o.is_metal ELSE i.is_metal END AS is_metal,
       CASE WHEN o.filename IS NOT NULL THEN o.brand ELSE i.brand END AS brand
FROM items i LEFT JOIN ok o ON i.filename = o.filename"""

# ---- synthetic data -------------------------------------------------------------



def _d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _draw(idx: str, salt: int, seed: int = 0) -> str:
    """First 13 hex digits of MD5 over 'id:salt:seed', as an integer."""
    return f"CAST('0x' || substr(md5(CAST({idx} AS VARCHAR) || ':{salt}:{seed}'), 1, 13) AS BIGINT)"


def _u(idx: str, salt: int, seed: int = 0) -> str:
    return f"(CAST({_draw(idx, salt, seed)} AS DOUBLE) / {_d(4503599627370496.0)})"


def _bounds(weights: list[float]) -> list[float]:
    total, acc, out = sum(map(Fraction, weights)), Fraction(0), []
    for w in weights:
        acc += Fraction(w)
        out.append(float(acc / total))
    return [*out[:-1], 1.0]


def _weighted(u: str, values, weights) -> str:
    whens = " ".join(f"WHEN {u} < {_d(b)} THEN '{v}'" for v, b in zip(values, _bounds(weights)))
    return f"CASE {whens} ELSE '{values[-1]}' END"


def _choice(values_sql: list[str], idx: str, salt: int, seed: int = 0) -> str:
    return f"[{', '.join(values_sql)}][{_draw(idx, salt, seed)} % {len(values_sql)} + 1]"


# FIXED VALUES of the two generator profiles
_HOURS = [0.05, 0.05, 0.05, 0.05, 0.05, 0.1, 0.2, 0.3, 0.4, 0.6, 0.5, 0.6,
          0.7, 0.6, 0.3, 0.2, 0.2, 0.4, 0.6, 0.6, 0.5, 0.4, 0.3, 0.1]
_PROFILES = {
    "python": {
        "points": 168,
        "brands": ["Amazon", "Walmart", "Apple", "Nike", "Starbucks", "Other"],
        "brand_weights": [0.5, 0.2, 0.1, 0.05, 0.1, 0.05],
        "recycle_rates": {"Amazon": 0.9, "Walmart": 0.25, "Apple": 0.15, "Nike": 0.1, "Starbucks": 0.7, "Other": 0.3},
        "compost_rates": {"Amazon": 0.1, "Walmart": 0.5, "Apple": 0, "Nike": 0.02, "Starbucks": 0.3, "Other": 0.2},
    },
    "matlab": {
        "points": 169,
        "brands": ["Amazon", "Walmart", "Coca-Cola", "Nestle", "Starbucks", "Other"],
        "brand_weights": [0.1, 0.2, 0.4, 0.25, 0.1, 0.05],
        "recycle_rates": {"Amazon": 0.9, "Walmart": 0.25, "Coca-Cola": 0.95, "Nestle": 0.95, "Starbucks": 0.7, "Other": 0.3},
        "compost_rates": {"Amazon": 0.1, "Walmart": 0.5, "Coca-Cola": 0, "Nestle": 0.02, "Starbucks": 0.3, "Other": 0.2},
    },
}
_P = _PROFILES["python"]
_U1000 = f"(CAST(event_id % 1000 AS DOUBLE) / {_d(1000.0)})"
_END = "date_trunc('hour', (SELECT max(ts) FROM events))"

SQL["hour_spine"] = f"""SELECT unnest(range({_END} - INTERVAL 7 DAY, {_END}, INTERVAL 1 HOUR)) AS hour_start"""

SQL["weighted_pick"] = f"""SELECT event_id, {_weighted(_U1000, _P['brands'], _P['brand_weights'])} AS brand FROM events"""


def _rate_case(rates: dict, key: str, default: float) -> str:
    whens = " ".join(f"WHEN {key} = '{b}' THEN {_d(r)}" for b, r in rates.items())
    return f"coalesce(CASE {whens} END, {_d(default)})"


def _hour_case(key: str) -> str:
    whens = " ".join(f"WHEN {key} = {i} THEN {_d(w)}" for i, w in enumerate(_HOURS))
    return f"coalesce(CASE {whens} END, {_d(0.1)})"


_MAXH = _d(max(_HOURS))

SQL["rate_lookup"] = f"""WITH {EP},
b AS (
  SELECT CAST(event_id AS VARCHAR) || '.jpg' AS filename,
         CASE WHEN k % 10 = 1 THEN NULL ELSE {_weighted(_U1000, _P['brands'], _P['brand_weights'])} END AS brand,
         CAST(hour(ts) AS INTEGER) AS hour
  FROM ep
)
SELECT filename,
       {_rate_case(_P['recycle_rates'], 'brand', 0.5)} AS recycling_prob,
       {_rate_case(_P['compost_rates'], 'brand', 0.1)} * ({_hour_case('hour')} / {_MAXH}) * 3 AS compost_prob
FROM b"""

_CITY = [f"{{'city': '{c}', 'state': '{s}'}}" for c, s in (
    ("San Francisco", "CA"), ("New York", "NY"), ("Los Angeles", "CA"), ("Austin", "TX"), ("Chicago", "IL"), ("Princeton", "NJ"))]
_ADJ = ["'tiny'", "'small'", "'medium'", "'large'", "'ultra large'", "'gigantic'"]
_DESC = ["'cardboard box'", "'plastic cup'", "'aluminum can'", "'paper bag'", "'plastic bottle'"]

def synth_sql(profile: str, seed: int = 0) -> str:
    p = _PROFILES[profile]
    hour_whens = " ".join(f"WHEN CAST(hour(time) AS INTEGER) = {i} THEN {_d(w)}" for i, w in enumerate(_HOURS))
    hour_rate = f"coalesce(CASE {hour_whens} END, {_d(0.1)})"
    return f"""WITH base AS (
  SELECT event_id AS id,
         {_END} - INTERVAL 7 DAY + to_hours(CAST({_draw('event_id', 1, seed)} % {p['points']} AS BIGINT)) AS time,
         {_choice(_CITY, 'event_id', 2, seed)} AS cs,
         {_weighted(_u('event_id', 3, seed), p['brands'], p['brand_weights'])} AS brand,
         {_choice(_ADJ, 'event_id', 5, seed)} || ' ' || {_choice(_DESC, 'event_id', 4, seed)} AS description
  FROM events
)
SELECT CAST(id AS VARCHAR) || '.jpg' AS filename, time, cs.state AS state, cs.city AS city, description,
       {_u('id', 6, seed)} < {_rate_case(p['recycle_rates'], 'brand', 0.5)} AS is_recyclable,
       {_u('id', 7, seed)} < {_rate_case(p['compost_rates'], 'brand', 0.1)}
           * ({hour_rate} / {_d(max(_HOURS))}) * 3 AS is_compostable,
       contains(description, 'aluminum can') AS is_metal,
       brand
FROM base"""


SQL["synth_items"] = synth_sql("python")
SQL["synth_items_matlab"] = synth_sql("matlab", seed=11)

# ---- streaming ------------------------------------------------------------------

SQL["stream_composition"] = f"""WITH {PREPARED}, {composition('hour')}
SELECT * FROM share_hour"""

SQL["stream_lifecycle"] = f"""WITH {EP}
SELECT CAST(event_id AS VARCHAR) || '.jpg' AS filename, ts AS time, 'NJ' AS state, 'Princeton' AS city,
       'item ' || event_id || ', try ' || CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS description,
       event_id % 2 = 0 AS is_recyclable, event_id % 3 = 0 AS is_compostable, event_id % 7 = 0 AS is_metal,
       'Brand#' || (event_id % 25 + 1) AS brand
FROM ep WHERE event_type = 'error'"""

SQL["stream_top_brands"] = SQL["top_brands"]

SQL["stream_dedupe"] = """SELECT DISTINCT CAST(event_id AS VARCHAR) || '.jpg' AS filename, ts AS time FROM events"""

SQL["stream_ingest"] = """SELECT CAST(event_id AS VARCHAR) || '.jpg' AS filename, e.ts AS time,
       'NJ' AS state, 'Princeton' AS city,
       CASE WHEN event_id % 50 = 0 THEN '' ELSE 'item ' || CAST(event_id AS VARCHAR) END AS description,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_recyclable,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 3 = 0 END AS is_compostable,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 5 = 0 END AS is_metal,
       CASE WHEN event_id % 50 = 0 OR event_id % 4 = 0 THEN ''
            ELSE 'Brand#' || CAST(event_id % 25 + 1 AS VARCHAR) END AS brand
FROM events e
JOIN part p ON CAST(json_extract_string(e.props, '$.k') AS INTEGER) = p.p_partkey"""

SQL["merge_in_place"] = SQL["merge_update"]

SQL["feed_type_evolution"] = rf"""WITH {ITEMS},
numbered AS (SELECT filename, brand, CAST(regexp_extract(filename, '^(\d+)', 1) AS BIGINT) AS n FROM items)
SELECT filename, brand, CASE n % 3 WHEN 0 THEN CAST(n AS DOUBLE) WHEN 1 THEN CAST(n * 4000000000 AS DOUBLE) ELSE n / 4 END AS weight
FROM numbered"""

SQL["json_array_feed"] = rf"""WITH {ITEMS}
SELECT filename, date_trunc('second', time) AS time, description || CASE CAST(regexp_extract(filename, '^(\d+)', 1) AS BIGINT) % 3
         WHEN 0 THEN '"}}],[{{\"' WHEN 1 THEN '\' ELSE '' END AS description, brand, is_recyclable
FROM items"""

SQL["composition_live"] = f"""WITH items AS ({SQL["merge_update"]}),
{PREPARED[PREPARED.index("prepared AS"):]}, {composition('hour')}
SELECT * FROM share_hour"""


# FIXED VALUES: the taxonomies' labels in the order of their slots
_TRASH1 = "Paper RECYCLE 0,Other TRASH 2,Plastic RECYCLE 0,G_M RECYCLE 0,Organic COMPOST 1"
_TRASH2 = "paper RECYCLE 0,cardboard RECYCLE 0,plastic RECYCLE 0,trash TRASH 2,metal METAL 1"
_QUICK = ("banana spinach lettuce cabbage peas cucumber tomato bellpepper chilipepper jalepeno capsicum paprika radish "
          "turnip grapes kiwi apple pear watermelon soybean").split()
_SLOW = "corn sweetcorn cauliflower eggplant potato sweetpotato onion garlic beetroot carrot".split()
_REUSE = "pineapple mango ginger lemon orange pomegranate".split()
_LABELS = ([("trash1", *x.split()) for x in _TRASH1.split(",")] + [("trash2", *x.split()) for x in _TRASH2.split(",")]
           + [("fruits", x, "QUICK_COMPOST", "0") for x in _QUICK] + [("fruits", x, "SLOW_COMPOST", "1") for x in _SLOW]
           + [("fruits", x, "REUSEABLE", "2") for x in _REUSE])
_SLOTS = ", ".join(f"({i}, '{m}', '{x}')" for i, (m, x) in enumerate(
    [(m, x) for m, x, _, _ in _LABELS] + [("trash1", "Unmapped")]))
_MAPPED = ", ".join(f"('{m}', '{x}', '{c}', {n})" for m, x, c, n in _LABELS)

SQL["top_label_models"] = f"""WITH components AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS at FROM embeddings
),
s AS (
  SELECT CAST(c.vec_id AS VARCHAR) || '.jpg' AS key, l.model, l.label, max(abs(CAST(c.x AS DOUBLE))) AS score
  FROM components c JOIN (VALUES {_SLOTS}) l(i, model, label) ON c.at % 47 = l.i
  GROUP BY c.vec_id, l.model, l.label
),
t AS (SELECT * FROM (VALUES {_MAPPED}) t(model, label, category, ordinal)),
r AS (
  SELECT s.key, s.model, t.category, s.label, s.score,
         row_number() OVER (PARTITION BY s.key, s.model ORDER BY s.score DESC, s.label ASC) AS rn
  FROM s JOIN t ON s.model = t.model AND s.label = t.label
)
SELECT key, model, CAST(1 AS INTEGER) AS rank, category, label, score FROM r WHERE rn = 1"""

SQL["composition_one_pass"] = SQL["composition_by_brand"]

# ---- sources and sinks ------------------------------------------------------------

SQL["replace_snapshot"] = SQL["scan_items"]

SQL["json_round_trip"] = f"""WITH {ITEMS}
SELECT filename, date_trunc('second', time) AS time, state, city, description, is_recyclable, is_compostable, is_metal, brand
FROM items"""

SQL["feed_schema_evolution"] = f"""WITH {ITEMS}
SELECT filename, description, brand,
       CASE WHEN description = '' THEN CAST(split_part(filename, '.', 1) AS BIGINT) / 2 END AS weight
FROM items"""

SQL["feed_rejects"] = """SELECT 'not json {' || CAST(event_id AS VARCHAR) AS record, 'malformed' AS reason
FROM events WHERE event_id % 50 = 0
UNION ALL SELECT '{"brand":"b' || CAST(event_id AS VARCHAR) || '"}', 'no filename' FROM events WHERE event_id % 50 = 25"""

SQL["binary_scan"] = """SELECT source, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS total_bytes
FROM documents GROUP BY source"""

SQL["stream_files"] = SQL["binary_scan"]

SQL["iso_text"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time_text FROM events"

SQL["last_dotted"] = """WITH paths AS (
  SELECT 'file:/data/images/' || CAST(event_id AS VARCHAR) || '.jpg' AS path FROM events
  UNION ALL SELECT url FROM pages
)
SELECT path, string_split(path, '.')[-1] AS suffix FROM paths"""
