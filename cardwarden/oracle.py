"""The catalog's queries as SQL for an independent engine, over the same raw tables."""

from __future__ import annotations

from cardwarden import constants as C
from cardwarden.operators.forest import average_path

DT = "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', e.ts)"
K = "cast(json_extract_string(e.props, '$.k') as int)"

TX = f"""tx as (
select cast(e.event_id as varchar) as "transaccionID", e.ts as fecha_hora_transaccion,
  cast(e.user_id as varchar) as "usuarioID", 'TER_' || cast(e.event_id % 97 as varchar) as "terminalID",
  'CRD_' || cast(e.user_id as varchar) as "tarjetaID", e.value as "TransactionAmt",
  {DT} as "TransactionDT", cast(e.user_id % 17397 + 1000 as int) as card1,
  cast(c.c_nationkey as double) as addr1, cast(c.c_nationkey % 7 + 80 as double) as addr2,
  {K} as "C1", cast(({K} * 3 + e.event_id) % 200 as int) as "C13",
  cast({DT} // 86400 as int) as "D1", cast(e.event_id * 37 % 1000 as double) / 2 as "V314",
  cast(e.event_id % 3 as double) as "V201", cast(e.event_id % 5 as double) as "V243",
  cast({K} % 4 as double) as "V257", cast({K} % 5 as int) as "C7",
  cast(e.user_id % 3 as double) as "V242", cast(e.event_id % 11 as double) / 4 as "V45",
  cast({K} % 7 as double) / 2 as "V246", cast(e.event_id % 2 as double) as "V200",
  cast({K} % 9 as double) / 4 as "V258", cast(e.event_id % 50 as int) as "C14",
  case e.event_type when 'purchase' then 'W' when 'view' then 'C' when 'click' then 'R'
    when 'signup' then 'H' else e.event_type end as "ProductCD",
  case e.user_id % 5 when 0 then 'visa' when 1 then 'mastercard' when 2 then 'american express'
    when 3 then 'discover' end as card4,
  case e.user_id % 4 when 0 then 'debit' when 1 then 'credit' when 2 then 'debit or credit'
    else 'charge card' end as card6,
  case e.user_id % 7 when 0 then 'gmail.com' when 1 then 'yahoo.com' when 2 then 'hotmail.com'
    when 3 then 'anonymous.com' when 4 then 'aol.com' when 5 then 'mail.example' end as "P_emaildomain",
  case c.c_mktsegment when 'MACHINERY' then 'desktop' when 'BUILDING' then 'desktop'
    when 'AUTOMOBILE' then 'mobile' when 'HOUSEHOLD' then 'mobile' end as "DeviceType",
  case e.event_id % 6 when 0 then 'Windows' when 1 then 'iOS Device' when 2 then 'MacOS'
    when 3 then 'Trident/7.0' when 4 then 'rv:11.0' end as "DeviceInfo",
  case when e.event_id % 29 = 0 then 1 else 0 end as "isFraud"
from events e left join customer c on e.user_id = c.c_custkey)"""

# exact sums of amounts, divided once
_FIXED = "cast({0} as decimal(18,4))"
_SUM = f"cast(sum({_FIXED}) as double)"
_SQUARES = f"cast(sum({_FIXED} * {_FIXED}) as double)"
MEAN = f"{_SUM} / nullif(count({{0}}), 0)"
VARIANCE = (f"greatest(count({{0}}) * {_SQUARES} - {_SUM} * {_SUM}, 0::double)"
            " / nullif(count({0}) * (count({0}) - 1), 0)")

PROFILES = f"""profiles as (
select cast(user_id as varchar) as "usuarioID", {MEAN.format('value')} as promedio_de_gastos,
  {VARIANCE.format('value')} as varianza_de_gastos
from events where user_id % 5 <> 0 group by user_id)"""

CARDS = """cards as (
select 'CRD_' || cast(o_orderkey as varchar) as "tarjetaID", cast(o_custkey as varchar) as "usuarioID",
  o_orderstatus as card6, o_orderpriority as card4,
  lpad(cast(o_orderkey * 7919 % 100000000 as varchar), 8, '0') as card_number,
  strftime(o_orderdate, '%y%m') as expiry_yymm, o_orderdate as event_time, o_orderkey as seq
from orders)"""

SPARSE = """sparse as (
select "transaccionID",
  case when cast("transaccionID" as bigint) % 10 >= 3 then "TransactionAmt" end as amt_gap,
  case when cast("transaccionID" as bigint) % 10 = 0 then addr1 end as addr_sparse,
  case when cast("transaccionID" as bigint) % 7 <> 0 then "ProductCD" end as cat_gap, "isFraud"
from tx)"""

RAW_SCORE = '(1::double / (1::double + exp(-5::double * ("TransactionAmt" - 135.027::double) / 239.163::double)))'

SCORED = f"""scored as (
select "transaccionID", "usuarioID", "tarjetaID", "ProductCD", card4, "DeviceType", "P_emaildomain",
  "TransactionAmt", fecha_hora_transaccion as processed_at, "isFraud",
  round({RAW_SCORE}, 4) as fraud_score, cast("transaccionID" as bigint) >= 500 as is_warmed_up
from tx)"""

ALERTS = """alerts as (
select *, case cast("transaccionID" as bigint) % 10 when 0 then 'flagged' when 1 then 'flagged'
    when 2 then 'flagged' when 3 then 'blocked' when 4 then 'dismissed' else 'confirmed_fraud'
    end as status,
  case when cast("transaccionID" as bigint) % 10 >= 3
    then cast("transaccionID" as bigint) % 56 + 5 end as review_minutes
from scored where fraud_score >= 0.5 and is_warmed_up)"""

ZSCORE = '("TransactionAmt" - 135.027::double) / 239.163::double'
ENGINEERED = f"""round({ZSCORE}, 4) as zscore_amt,
  round(cast("C1" as double) / greatest("D1", 1), 4) as velocity,
  round(abs({ZSCORE}), 4) as amt_distance"""

ENRICHED = f"""enriched as (
select "transaccionID", "usuarioID", "tarjetaID", "TransactionAmt", "TransactionDT", card1, card4,
  card6, "ProductCD", "P_emaildomain", addr1, addr2, "DeviceType", "DeviceInfo",
  "C1", "C13", "C7", "C14", "D1", "V314", "V201", "V243", "V257", "V242", "V45", "V246", "V200",
  "V258", {ENGINEERED},
  case when cast("transaccionID" as bigint) % 100 <> 0 then round({RAW_SCORE}, 4) end as fraud_score,
  cast("transaccionID" as bigint) % 100 <> 0 and {RAW_SCORE} >= 0.5 as is_suspicious,
  true as model_ready, true as is_warmed_up, fecha_hora_transaccion as processed_at, "isFraud"
from tx)"""

ALERT_ROWS = """select "transaccionID", "usuarioID", "tarjetaID", "TransactionAmt", fraud_score,
  zscore_amt, velocity, "isFraud" as "isFraud_label", processed_at as alerted_at,
  'flagged' as status, cast(null as varchar) as reviewed_by, cast(null as timestamp) as reviewed_at
from enriched where is_suspicious"""

EVALUABLE = "evaluable as (select * from scored where fraud_score is not null and is_warmed_up)"

CONFUSION = """confusion as (
select count(*) filter ("isFraud" = 0 and fraud_score < 0.5) as tn,
  count(*) filter ("isFraud" = 0 and fraud_score >= 0.5) as fp,
  count(*) filter ("isFraud" = 1 and fraud_score < 0.5) as fn,
  count(*) filter ("isFraud" = 1 and fraud_score >= 0.5) as tp
from evaluable)"""

AUC = """auc as (
select sum(p * (below + q / 2)) / (sum(p) * sum(q)) as auc_roc from (
  select p, q, coalesce(sum(q) over (order by fraud_score rows between unbounded preceding
    and 1 preceding), 0) as below
  from (select fraud_score, cast(count(*) filter ("isFraud" = 1) as double) as p,
          cast(count(*) filter ("isFraud" = 0) as double) as q
        from evaluable group by fraud_score)))"""


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _rate_case(name: str) -> str:
    whens = " ".join(f"when '{k}' then {v}::double" for k, v in C.CATEGORY_RATES[name].items())
    return f'case "{name}" {whens} else {C.DEFAULT_RATE}::double end as "{name}_rate"'


RATES = ", ".join(_rate_case(name) for name in C.CATEGORY_RATES)
RATIO = '"TransactionAmt" / greatest(coalesce(promedio_de_gastos, 135.027::double), 1::double)'
RELATIVE = f"""{RATIO} as ratio_vs_user,
  ("TransactionAmt" - coalesce(promedio_de_gastos, 135.027::double))
    / greatest(sqrt(coalesce(varianza_de_gastos, 239.163::double * 239.163::double)), 1::double) as zscore_vs_user"""


def _long(columns: list[str], extra: str = "") -> str:
    return " union all ".join(
        f"""select '{c}' as column_name, "{c}" as value{extra} from tx""" for c in columns)


CATS = list(C.CATEGORY_RATES)
NUMS = ["TransactionAmt", "C1", "C13", "V314"]


def _each(template: str, columns: list[str]) -> str:
    return " union all ".join(template.replace("{c}", c) for c in columns)


RULE = f"""least(0.03499::double
  + case when "TransactionAmt" > 135.027::double + 2 * 239.163::double then 0.15::double else 0::double end
  + case when "V314" > 43.23::double + 173.44::double then 0.10::double else 0::double end, 0.85::double)"""


def _ratio(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then cast({part} as double) / ({whole}) else 0::double end"


def _report_row(name: str, hit: str, false_hit: str, missed: str) -> str:
    return f"""select '{name}' as class, {_ratio(hit, f'{hit} + {false_hit}')} as precision,
  {_ratio(hit, f'{hit} + {missed}')} as recall,
  {_ratio(f'2 * {hit}', f'2 * {hit} + {false_hit} + {missed}')} as f1, {hit} + {missed} as support
from confusion"""


SPLIT = """sizes as (select "isFraud", count(*) as c,
    count(*) * ceil(sum(count(*)) over () * 0.2::double) / sum(count(*)) over () as exact,
    ceil(sum(count(*)) over () * 0.2::double) as draws from tx group by "isFraud"),
quota as (select "isFraud", floor(exact) + case when row_number() over (order by exact - floor(exact) desc, "isFraud")
    <= draws - sum(floor(exact)) over () then 1 else 0 end as take from sizes),
split as (select t."transaccionID", t."isFraud", row_number() over (partition by t."isFraud"
    order by md5('42:' || t."transaccionID")) <= take as is_test
from tx t join quota q on t."isFraud" = q."isFraud")"""

FEATURES = 'select "transaccionID", ' + ", ".join(
    f'coalesce(cast("{c}" as double), 0) as "{c}"' for c in C.NUMERIC_FEATURES) + f""", {RATES},
  {RELATIVE} from tx left join profiles using ("usuarioID")"""

FEATURE_NAMES = [*C.NUMERIC_FEATURES, *[f"{c}_rate" for c in C.CATEGORY_RATES], *C.BEHAVIOUR_FEATURES]

# the three trees of the catalog's fixed forest, walked by hand
FIXED_OFFSET = -0.6
FIXED = f"""walked as (
select *, (case when "TransactionAmt" > 100 then case when "C13" > 150 then 2.5::double else 7.25::double end
    else 11.5::double end
  + case when "V314" > 400 then 3::double else 10::double end
  + case when {RATIO} > 1.5 then 1.75::double else 12::double end) / 3 as depth
from tx left join profiles using ("usuarioID")),
fixed as (select *, 1::double / (1::double + exp(5::double * (s - {FIXED_OFFSET}::double) / abs({FIXED_OFFSET}::double))) as score
from (select *, -pow(2::double, -depth / {float(average_path(256))!r}::double) as s from walked))"""


SUSPECT = """suspect as (
select "transaccionID", cast("transaccionID" as bigint) as n from tx)"""

VIOLATIONS = """violations as (
select "transaccionID", 'TransactionAmt' as field, 'required' as rule from suspect where n % 31 = 0
union all select "transaccionID", 'TransactionAmt', 'type:double' from suspect where n % 31 <> 0 and n % 37 = 0
union all select "transaccionID", 'isFraud', 'allowed' from suspect where n % 41 = 0)"""

HISTOGRAM = """, span as (select min("TransactionAmt") as low, max("TransactionAmt") as high from tx)
select cast(least(floor(("TransactionAmt" - low) / ((high - low) / 50)), 49) as int) as bin, count(*) as n,
  round(any_value(low) + cast(least(floor(("TransactionAmt" - low) / ((high - low) / 50)), 49) as int)
    * any_value((high - low) / 50), 6) as bin_start
from tx, span group by 1, least(floor(("TransactionAmt" - low) / ((high - low) / 50)), 49)"""

QUARTILES = _each("""select '{c}' as column_name, quantile_cont("{c}", 0.25) as q25,
  quantile_cont("{c}", 0.5) as q50, quantile_cont("{c}", 0.75) as q75 from tx""", NUMS)

_PAIRS = [*NUMS, "C7", "isFraud", "constant", "gappy"]


def _correlations(columns: list[str], source: str) -> str:
    """All pairs; a column that does not vary within a pair gives null."""
    def varies(a: str, b: str) -> str:
        return f"""stddev_pop(case when "{b}" is not null then "{a}" end) > 0"""

    entries = ", ".join(
        f"""{{'col_a': '{a}', 'col_b': '{b}', 'corr': case when {varies(a, b)} and {varies(b, a)}
  then round(corr("{a}", "{b}"), 6) end}}""" for a in columns for b in columns)
    return f"select unnest(list_value({entries}), recursive := true) from {source}"


CORRELATION = _correlations(_PAIRS, """(select *, 0.1::double as constant,
  case when "C7" > 1 then "V314" end as gappy from tx)""")

_WIDE = ", ".join(
    f"case when (event_id + {k}) % {k + 3} <> 0 then "
    + ("1.0::double" if k == 59 else f"cast(event_id * {k * 7 + 3} % {101 + k} as double) / 2")
    + f" end as w{k}" for k in range(60))
CORRELATION_WIDE = "with wide as (select " + _WIDE + " from events) " + _correlations(
    [f"w{k}" for k in range(60)], "wide")

PROFILE_KEYS_SQL = """card1, coalesce(card4, 'unknown') as card4, coalesce(card6, 'unknown') as card6,
  coalesce("ProductCD", 'W') as "ProductCD", coalesce("P_emaildomain", 'unknown.com') as "P_emaildomain",
  coalesce(addr1, 999.0) as addr1, coalesce(addr2, 99.0) as addr2,
  coalesce("DeviceType", 'unknown') as "DeviceType", coalesce("DeviceInfo", 'unknown') as "DeviceInfo\""""

TOP_CARDS = "top_cards as (select card1, count(*) as n from tx group by card1 order by n desc, card1 limit 10)"


def _code(c: str) -> str:
    return f"""dense_rank() over (order by coalesce("{c}", 'nan')) - 1 as "{c}\""""


QUARANTINED = _with(TX) + """
select cast(null as varchar) as "transaccionID", 'not json ' || "transaccionID" as record,
  'unreadable' as reason from tx where cast("transaccionID" as bigint) % 50 = 0
union all
select "transaccionID", '{"transaccionID":"' || "transaccionID" || '","usuarioID":"' || "usuarioID"
  || '","TransactionAmt":"x","C1":' || cast("C1" as varchar) || ',"isFraud":' || cast("isFraud" as varchar)
  || '}', 'wrong_type' from tx where cast("transaccionID" as bigint) % 50 = 1"""

SQL: dict[str, str] = {
    "parse_events_json": _with(TX) + """select "transaccionID", "usuarioID",
  case when cast("transaccionID" as bigint) % 50 <> 1 then "TransactionAmt" end as "TransactionAmt",
  "C1", "isFraud" from tx where cast("transaccionID" as bigint) % 50 not in (0, 2)""",
    "quarantine_split": QUARANTINED,
    "raw_projection": _with(TX) + """select "transaccionID", "usuarioID", "tarjetaID",
  fecha_hora_transaccion, "TransactionAmt", "TransactionDT", "isFraud",
  fecha_hora_transaccion as ingested_at from tx""",
    "enriched_projection": _with(TX, ENRICHED) + "select * from enriched",
    "alert_projection": _with(TX, ENRICHED) + ALERT_ROWS,
    "cached_model_alerts": _with(TX, ENRICHED)
    + "select count(*) filter (is_suspicious) as suspicious, cast(0 as bigint) as alerts from enriched",
    "score_feed": _with(TX, ENRICHED)
    + """select "transaccionID", fraud_score from enriched where fraud_score is not null""",
    "alert_feed": _with(TX, ENRICHED) + """select "transaccionID" as key,
  '{"transaccionID":"' || "transaccionID" || '","TransactionAmt":' || cast("TransactionAmt" as varchar)
  || ',"fraud_score":' || cast(fraud_score as varchar) || ',"isFraud_label":' || cast("isFraud" as varchar)
  || ',"alerted_at":"' || strftime(processed_at, '%Y-%m-%dT%H:%M:%S.%f') || '","status":"flagged"}' as value
from enriched where is_suspicious""",
    "keep_existing_columns": _with(TX) + 'select "TransactionAmt", "C1", "isFraud" from tx',
    "drop_identifier_columns": _with(TX) + 'select "transaccionID", "TransactionAmt" from tx',
    "anomaly_flags": _with(TX, SCORED) + """select "transaccionID",
  case when fraud_score > 0.9 then 1 else 0 end as anomaly from scored""",
    "profile_join": _with(TX, PROFILES) + """select "transaccionID", "usuarioID", "TransactionAmt",
  coalesce(promedio_de_gastos, 135.027::double) as promedio_de_gastos,
  coalesce(varianza_de_gastos, 239.163::double * 239.163::double) as varianza_de_gastos
from tx left join profiles using ("usuarioID")""",
    "card_join": _with(TX, CARDS) + """select "transaccionID", "usuarioID", "tarjetaID_1" as "card_tarjetaID",
  card4_1 as card_card4, card6_1 as card_card6
from (select "transaccionID", "usuarioID" from tx) t join (
  select "usuarioID", "tarjetaID" as "tarjetaID_1", card4 as card4_1, card6 as card6_1 from cards
  qualify row_number() over (partition by "usuarioID" order by event_time desc, seq desc) = 1) c
using ("usuarioID")""",
    "card_left_join": _with(TX, CARDS) + """select t."transaccionID", t."tarjetaID",
  c.card4 as card_card4, c.card6 as card_card6
from tx t left join cards c on t."tarjetaID" = c."tarjetaID\"""",
    "identity_left_join": _with(TX) + """select "transaccionID", "TransactionAmt", "isFraud", id_01, id_02
from tx left join (select cast(o_orderkey as varchar) as "transaccionID", o_orderpriority as id_01,
  o_totalprice as id_02 from orders where o_orderstatus = 'O') using ("transaccionID")""",
    "dedupe_anti_join": """select user_id as "user", event_id, ts, value from events
where user_id not in (select c_custkey from customer where c_acctbal < 0)
qualify row_number() over (partition by user_id order by ts, event_id) = 1""",
    "category_rate_lookup": _with(TX) + f"""select "transaccionID", {', '.join(f'"{c}"' for c in CATS)}, {RATES} from tx""",
    "engineered_features": _with(TX) + f"""select "transaccionID", "TransactionAmt", "C1", "D1", {ENGINEERED} from tx""",
    "user_relative_features": _with(TX, PROFILES)
    + f"""select "transaccionID", {RELATIVE} from tx left join profiles using ("usuarioID")""",
    "feature_vector": _with(TX, PROFILES) + 'select "transaccionID", ' + ", ".join(
        f'coalesce(cast("{c}" as double), 0) as "{c}"' for c in C.NUMERIC_FEATURES)
    + f""", {RATES}, {RELATIVE} from tx left join profiles using ("usuarioID")""",
    "feature_vector_length": "select cast(27 as int) as entries, count(*) as n from events",
    "rule_probability": _with(TX) + f"""select "transaccionID", {RULE} as probability,
  {RULE} >= 0.1 as suspicious from tx""",
    "sigmoid_score": _with(TX) + """select "transaccionID",
  round(case when cast("transaccionID" as bigint) % 9 = 0 then 0.5::double else
    1::double / (1::double + exp(5::double * (-("TransactionAmt" / ("TransactionAmt" + 60)) + 0.55::double) / 0.55::double))
  end, 6) as score from tx""",
    "amt_ratio_log": _with(TX) + """select "transaccionID", "TransactionAmt",
  round("TransactionAmt" / ((select avg("TransactionAmt") from tx) + 1e-9), 6) as amt_ratio,
  round(ln(1 + "TransactionAmt"), 6) as log_amt from tx""",
    "safe_casts": """select o_orderkey, 7.5::double as bad_double, o_totalprice as good_double,
  cast(left(o_orderpriority, 1) as int) as good_int, cast(1 as int) as bad_int from orders""",
    "clip_and_inflate": _with(TX) + """select "transaccionID",
  least(greatest("TransactionAmt", 5::double), 100::double) as clipped,
  least(greatest("TransactionAmt" * (8 * "C1"), 0.251::double), 31937.391::double) as inflated from tx""",
    "hour_and_day_index": _with(TX) + """select "transaccionID",
  cast(((floor(("TransactionDT" - 500000) / 3600) % 24) + 24) % 24 as int) as hour,
  cast(((floor(("TransactionDT" - 500000) / 86400) % 7) + 7) % 7 as int) as day from tx""",
    "email_domain": """select c_custkey, 'mail' || cast(c_nationkey as varchar) || '.example' as domain from customer""",
    "mask_card": _with(CARDS) + """select "tarjetaID", '**** **** **** ' || right(card_number, 4) as masked from cards""",
    "expiry_format": _with(CARDS) + """select "tarjetaID", case when seq % 10 = 0 then '12/2026'
  else substr(expiry_yymm, 3) || '/20' || substr(expiry_yymm, 1, 2) end as expiry from cards""",
    "secret_round_trip": _with(CARDS) + """select "tarjetaID", seq % 2 <> 0 as kept,
  case when seq % 2 = 0 then card_number else card_number || card_number || card_number end as back from cards""",
    "iso_timestamps": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as iso from events""",
    "label_encode": _with(TX) + f"""select "transaccionID", {_code('ProductCD')}, {_code('card4')},
  {_code('DeviceInfo')} from tx""",
    "fill_defaults": _with(TX) + f"""select "transaccionID", {PROFILE_KEYS_SQL} from tx""",
    "constant_fill": _with(TX, SPARSE) + """select "transaccionID", coalesce(amt_gap, -999) as amt_gap,
  coalesce(addr_sparse, -999) as addr_sparse, coalesce(cat_gap, '-999') as cat_gap, "isFraud" from sparse""",
    "fraud_rate": _with(TX) + """select count(*) as n, avg("isFraud") * 100 as fraud_pct,
  case when avg("isFraud") > 0 and avg("isFraud") < 0.5 then avg("isFraud") else 0.035::double end as contamination from tx""",
    "null_profile": _with(TX, SPARSE) + _each("""select '{c}' as column_name,
  avg(case when "{c}" is null then 1 else 0 end) * 100 as null_pct from sparse having null_pct > 0""",
        ["transaccionID", "amt_gap", "addr_sparse", "cat_gap", "isFraud"]),
    "null_share_histogram": _with(TX, SPARSE) + """, shares as (
  select avg(case when amt_gap is null then 100::double else 0::double end) as p from sparse
  union all select avg(case when addr_sparse is null then 100::double else 0::double end) from sparse
  union all select avg(case when cat_gap is null then 100::double else 0::double end) from sparse),
span as (select min(p) as low, max(p) as high from shares where p > 0)
select cast(least(floor((p - low) / ((high - low) / 10)), 9) as int) as bin, count(*) as n,
  round(any_value(low) + cast(least(floor((p - low) / ((high - low) / 10)), 9) as int) * any_value((high - low) / 10), 6) as bin_start
from shares, span where p > 0 group by 1, least(floor((p - low) / ((high - low) / 10)), 9)""",
    "sparse_column_count": _with(TX, SPARSE) + """select cast(
  (avg(case when amt_gap is null then 1 else 0 end) > 0.8)::int
  + (avg(case when addr_sparse is null then 1 else 0 end) > 0.8)::int
  + (avg(case when cat_gap is null then 1 else 0 end) > 0.8)::int as bigint) as sparse_columns from sparse""",
    "drop_sparse": _with(TX, SPARSE) + """select "transaccionID", amt_gap, cat_gap, "isFraud" from sparse""",
    "median_impute": _with(TX, SPARSE) + """select "transaccionID",
  round(coalesce(amt_gap, (select median(amt_gap) from sparse)), 6) as amt_gap,
  round(coalesce(addr_sparse, (select median(addr_sparse) from sparse)), 6) as addr_sparse from sparse""",
    "mode_impute": _with(TX, SPARSE) + """select "transaccionID", coalesce(cat_gap, (
  select cat_gap from sparse where cat_gap is not null group by cat_gap order by count(*) desc, cat_gap limit 1)) as cat_gap
from sparse""",
    "clean_dataset": _with(TX, SPARSE) + """select "transaccionID",
  round(coalesce(amt_gap, (select median(amt_gap) from sparse)), 6) as amt_gap,
  coalesce(cat_gap, (select cat_gap from sparse where cat_gap is not null
    group by cat_gap order by count(*) desc, cat_gap limit 1)) as cat_gap, "isFraud" from sparse""",
    "category_label_counts": _with(TX) + f"""select column_name, value, "isFraud", count(*) as n
from ({_long(["ProductCD", "card4", "card6"], ', "isFraud"')}) where value is not null group by all""",
    "label_counts": _with(TX) + 'select "isFraud", count(*) as n from tx group by all',
    "correlation_matrix": _with(TX) + CORRELATION,
    "correlation_wide": CORRELATION_WIDE,
    "describe_numeric": _with(TX) + _each("""select '{c}' as column_name, count("{c}") as n,
  round(avg("{c}"), 6) as mean, round(stddev_samp("{c}"), 6) as std, cast(min("{c}") as double) as min,
  round(quantile_cont("{c}", 0.25), 6) as q25, round(quantile_cont("{c}", 0.5), 6) as q50,
  round(quantile_cont("{c}", 0.75), 6) as q75, cast(max("{c}") as double) as max from tx""", NUMS),
    "histogram_50": _with(TX) + HISTOGRAM,
    "box_statistics": _with(TX) + f""", quartiles as ({QUARTILES}), long as ({_each(
        '''select '{c}' as column_name, cast("{c}" as double) as v from tx''', NUMS)})
select column_name, round(q25, 6) as q25, round(q50, 6) as q50, round(q75, 6) as q75,
  round(q25 - 1.5 * (q75 - q25), 6) as low_fence, round(q75 + 1.5 * (q75 - q25), 6) as high_fence,
  count(*) filter (v < q25 - 1.5 * (q75 - q25) or v > q75 + 1.5 * (q75 - q25)) as outliers
from quartiles join long using (column_name) group by all""",
    "iqr_outliers": _with(TX) + """, q as (select quantile_cont("TransactionAmt", 0.25) as a,
  quantile_cont("TransactionAmt", 0.75) as b from tx)
select "transaccionID", "TransactionAmt" from tx, q
where "TransactionAmt" < a - 1.5 * (b - a) or "TransactionAmt" > b + 1.5 * (b - a)""",
    "mean_spend_per_card": _with(TX) + 'select card1, ' + MEAN.format('"TransactionAmt"') + ' as mean_spend from tx group by card1',
    "mean_of_card_means": _with(TX)
    + 'select round(avg(m), 6) as mean_of_means from (select ' + MEAN.format('"TransactionAmt"') + ' as m from tx group by card1)',
    "fraud_by_hour": _with(TX) + """select cast("TransactionDT" // 3600 % 24 as int) as hour,
  avg("isFraud") * 100 as fraud_pct from tx group by 1""",
    "fraud_by_day": _with(TX) + """select cast("TransactionDT" // 86400 % 7 as int) as day_of_week,
  cast(sum("isFraud") as bigint) as frauds from tx group by 1""",
    "top_cards": _with(TX, TOP_CARDS) + "select * from top_cards",
    "top_card_rows": _with(TX, TOP_CARDS)
    + 'select card1, "transaccionID" from tx where card1 in (select card1 from top_cards)',
    "spend_pivot": _with(TX, TOP_CARDS) + """select card1,
  round(coalesce(sum("TransactionAmt") filter ("isFraud" = 0), 0), 6) as legit_amt,
  round(coalesce(sum("TransactionAmt") filter ("isFraud" = 1), 0), 6) as fraud_amt
from tx where card1 in (select card1 from top_cards) group by card1""",
    "numeric_profile": _with(TX) + _each("""select '{c}' as column_name, round(avg("{c}"), 6) as mean,
  round(median("{c}"), 6) as median, round(stddev_samp("{c}"), 6) as std,
  round(var_samp("{c}"), 6) as variance, cast(min("{c}") as double) as min,
  cast(max("{c}") as double) as max from tx""", NUMS),
    "categorical_top5": _with(TX) + f""", counts as (select column_name, value, count(*) as n
  from ({_long(CATS)}) where value is not null group by all)
select column_name, value, n / sum(n) over (partition by column_name) as share from counts
qualify row_number() over (partition by column_name order by n desc, value) <= 5""",
    "spending_profiles": _with(TX) + f"""select {PROFILE_KEYS_SQL}, {MEAN.format('"TransactionAmt"')} as mean,
  coalesce({VARIANCE.format('"TransactionAmt"')}, 0::double) as var, count("TransactionAmt") as count
from tx group by 1, 2, 3, 4, 5, 6, 7, 8, 9 order by count desc, 1, 2, 3, 4, 5, 6, 7, 8, 9 limit 5000""",
    "category_fraud_rates": _with(TX) + f"""select column_name, value, avg("isFraud") as rate,
  count(*) as n from ({_long(CATS, ', "isFraud"')}) where value is not null group by column_name, value""",
    "evaluable_rows": _with(TX, SCORED, EVALUABLE) + 'select "transaccionID", fraud_score, "isFraud" from evaluable',
    "confusion_metrics": _with(TX, SCORED, EVALUABLE, CONFUSION) + f"""select tn, fp, fn, tp,
  {_ratio('tp', 'tp + fp')} as precision, {_ratio('tp', 'tp + fn')} as recall,
  {_ratio('2 * tp', '2 * tp + fp + fn')} as f1 from confusion""",
    "class_report": _with(TX, SCORED, EVALUABLE, CONFUSION)
    + f""", rows_by_class as ({_report_row('legit', 'tn', 'fn', 'fp')} union all {_report_row('fraud', 'tp', 'fp', 'fn')}),
every_row as (select * from rows_by_class
union all select 'accuracy', (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn),
  (tp + tn) / (tp + fp + fn + tn), tp + fp + fn + tn from confusion
union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from rows_by_class
union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), cast(sum(support) as bigint) from rows_by_class)
select * from every_row""",
    "roc_auc": _with(TX, SCORED, EVALUABLE, AUC) + "select auc_roc from auc",
    "evaluation_summary": _with(TX, SCORED, EVALUABLE) + """select count(*) as n_samples,
  cast(sum("isFraud") as bigint) as n_real_frauds, count(*) filter (fraud_score >= 0.5) as n_alerts,
  round(avg("isFraud"), 6) as fraud_rate, round(avg(fraud_score), 6) as score_mean,
  max(fraud_score) as score_max,
  case when sum("isFraud") in (0, count(*)) then 'only one class in the data' end as class_warning,
  case when count(*) < 100 then 'fewer rows than recommended' end as sample_warning from evaluable""",
    "model_metrics_row": _with(TX, SCORED, EVALUABLE, CONFUSION, AUC) + f"""
select TIMESTAMP '2024-02-01 00:00:00' as evaluated_at, tp + fp + tn + fn as samples_evaluated,
  0.5::double as threshold, auc_roc,
  {_ratio('2 * tp', '2 * tp + fp + fn')} as f1_score, {_ratio('tp', 'tp + fn')} as recall,
  {_ratio('tp', 'tp + fp')} as precision, tp as true_positives, fp as false_positives,
  tn as true_negatives, fn as false_negatives, '{C.MODEL_VERSION}' as model_version,
  0.035::double as contamination_rate from confusion, auc""",
    "last_n_window": "select event_id, ts, user_id, value from events order by ts desc, event_id desc limit 5000",
    "warmup_rows": "select event_id, ts, user_id, value from events order by ts, event_id limit 500",
    "latest_per_user": """select user_id, event_id, ts, event_type, value from events
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "recent_per_user": """select user_id, event_id, ts, value,
  cast(row_number() over (partition by user_id order by ts desc, event_id desc) as int) as recency
from events qualify recency <= 5""",
    "top_alerts": _with(TX, SCORED, ALERTS) + """select "transaccionID", fraud_score, processed_at, status
from alerts order by fraud_score desc, processed_at desc, "transaccionID" limit 50""",
    "latest_alerts": _with(TX, SCORED, ALERTS) + """select "transaccionID", fraud_score, processed_at, status
from alerts order by processed_at desc, "transaccionID" limit 50""",
    "batch_counters": _with(TX, ENRICHED) + """select count(*) as rows, count(*) filter (is_suspicious) as alerts,
  count(fraud_score) as total_scored,
  count(*) filter (is_suspicious and fraud_score is not null) as total_at_threshold from enriched""",
    "fraud_rate_drift": _with(TX) + """, days as (select date_trunc('day', fecha_hora_transaccion) as window_start,
  count(*) as n, cast(sum("isFraud") as bigint) as frauds from tx group by 1),
running as (select *, sum(frauds) over (order by window_start) / sum(n) over (order by window_start) as r from days)
select cast(window_start as timestamp) as window_start, n, frauds, frauds / n as rate,
  r as running_rate, r - 0.03499::double as drift from running""",
    "dimension_breakdown": _with(TX, SCORED) + ", long as (" + _each(
        """select processed_at, fraud_score, '{c}' as dimension, "{c}" as value from scored""",
        ["card4", "DeviceType", "P_emaildomain"]) + """)
select cast(date_trunc('day', processed_at) as timestamp) as window_start, dimension, value, count(*) as n,
  count(*) filter (fraud_score >= 0.5) as suspicious, """ + MEAN.format("fraud_score") + """ as mean_score
from long group by 1, 2, 3""",
    "alert_triage": _with(TX, SCORED, ALERTS) + """select status, count(*) as n,
  avg(review_minutes) as mean_minutes, count(*) / sum(count(*)) over () as share
from alerts group by status""",
    "handled_share": _with(TX, SCORED, ALERTS) + """select count(*) as n,
  avg(case when status <> 'flagged' then 1 else 0 end) as handled_share from alerts""",
    "schema_violations": _with(TX, SUSPECT, VIOLATIONS) + "select * from violations",
    "violation_counts": _with(TX, SUSPECT, VIOLATIONS)
    + "select field, rule, count(*) as n from violations group by field, rule",
    "unique_key_violations": """select l_orderkey, l_linenumber, count(*) as n from lineitem
group by l_orderkey, l_linenumber having count(*) > 1""",
    "retention_filter": _with(TX) + """select "transaccionID", fecha_hora_transaccion from tx
where fecha_hora_transaccion > TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY""",
    "split_test_rows": _with(TX, SPLIT) + "select * from split",
    "stream_scored": _with(TX, PROFILES, FIXED) + f"""select "transaccionID", "usuarioID", "TransactionAmt",
  {ENGINEERED}, round(score, 4) as fraud_score, score >= 0.5 as is_suspicious, false as is_warmed_up,
  cast(1 as bigint) as model_version, "isFraud" from fixed""",
    "session_counters": _with(TX, PROFILES, FIXED) + """, batches as (
  select cast(greatest(least("D1" // 8, 3), 0) as bigint) as batch_id, count(*) as r, count(*) filter (score >= 0.5) as t
  from fixed group by 1)
select batch_id, cast(sum(r) over so_far as bigint) as rows, cast(0 as bigint) as alerts,
  cast(sum(r) over so_far as bigint) as total_scored, cast(sum(t) over so_far as bigint) as total_at_threshold
from batches window so_far as (order by batch_id)""",
    "stream_quarantine": QUARANTINED,
    "stream_alerts": _with(TX) + """select "transaccionID", "usuarioID", "TransactionAmt",
  "isFraud" as "isFraud_label", 'flagged' as status from tx where greatest(least("D1" // 8, 3), 0) <> 0""",
    "stream_dedupe_two_batches": _with(TX) + """select "transaccionID", amount as raw_amount, amount as "TransactionAmt"
from (select "transaccionID", "TransactionAmt" * case cast("transaccionID" as bigint) % 3 when 2 then 2 else 1 end
  as amount from tx)""",
    "stream_dedupe_stateful": _with(TX) + """select "transaccionID",
  "TransactionAmt" * case cast("transaccionID" as bigint) % 3 when 2 then 2 else 1 end as "TransactionAmt",
  cast(case cast("transaccionID" as bigint) % 3 when 0 then fecha_hora_transaccion
    when 2 then fecha_hora_transaccion + interval 3 days end as date) as day from tx""",
    "day_table_compaction": _with(TX) + """select cast(fecha_hora_transaccion as date) as day, count(*) as n,
  count(distinct "transaccionID") as keys, round(sum("TransactionAmt"), 2) as amount, true as few_files from tx group by 1""",
    "day_table_lookup": _with(TX) + """select "transaccionID", "usuarioID", fecha_hora_transaccion from tx
where cast("transaccionID" as bigint) % 4 <> 0""",
    "importance_contract": """select 'decisive' as first, cast(7 as bigint) as features, true as shares,
  cast(0 as double) as of_the_constant""",
    "segment_stream": """select cast(user_id % 3 as int) as partition,
  row_number() over (partition by user_id % 3 order by event_id) - 1 as "offset", event_id, true as bounded from events""",
    "outbox_replay": _with(TX) + """select row_number() over (
  order by cast("transaccionID" as bigint) % 3, "transaccionID") - 1 as number, "transaccionID" from tx where "isFraud" = 1""",
    "stored_key_violations": _with(TX) + """, counted as (
  select count(*) as n, count(*) filter (greatest(least("D1" // 8, 3), 0) <> 0) as alerted,
    count(distinct "usuarioID") as users from tx)
select unnest(['user_profiles', 'cards', 'transactions_raw', 'transactions_enriched', 'fraud_alerts']) as table_name,
  unnest([users, users, n, n, alerted]) as rows, unnest([users, users, n, n, alerted]) as keys,
  cast(0 as bigint) as keyless from counted""",
    "lifecycle_run": _with(TX) + """select case when k > 0 then k end as model_version, k > 0 as is_warmed_up,
  count(*) as n, case when k > 0 then count(*) else 0 end as scored
from (select cast(greatest(least("D1" // 8, 3), 0) as bigint) as k from tx) group by k""",
    "scaling_stats": _with(TX, PROFILES) + ", features as (" + FEATURES + "), stats as (" + " union all ".join(
        f"""select '{c}' as feature, avg("{c}") as m, coalesce(nullif(stddev_pop("{c}"), 0), 1) as d from features"""
        for c in FEATURE_NAMES) + """)
select feature, case when abs(m) < 1000 then round(m, 4) else round(m, 1) end as mean,
  case when abs(d) < 1000 then round(d, 4) else round(d, 1) end as std from stats""",
    "fixed_forest_scores": _with(TX, PROFILES, FIXED) + f"""select "transaccionID", round(s, 6) as anomaly_score,
  round(s - {FIXED_OFFSET}::double, 6) as decision,
  case when s - {FIXED_OFFSET}::double < 0 then -1 else 1 end as prediction, round(score, 6) as score from fixed""",
    "forest_contract": """select cast(t as int) as tree_id, least(1024, n) as root_rows, least(1024, n) as leaf_rows,
  true as within_height from range(300) r(t), (select count(*) as n from events)""",
    "offset_share": "select count(*) as n, true as at_rank from events",
    "grid_contract": """select cast(trees as int) as trees, max_samples, cast(c as double) as contamination,
  (select cast(ceil(count(*) * 0.2::double) as bigint) from events) as test_rows
from (values (10), (30)) a(trees), (values ('auto'), ('1024'), ('2048')) b(max_samples),
  (values (0.035), (0.05), (0.08)) d(c)""",
    "comparison_contract": _with(TX, SPLIT) + """, parts as (
  select count(*) filter (is_test) as test_rows, count(*) filter (is_test and "isFraud" = 1) as frauds,
    count(*) filter (not is_test) as train_rows from split)
select model, n_features, cast(10 as int) as trees, least(asked, train_rows) as sample_size, frauds, test_rows
from parts, (values ('base', 27, 256), ('tuned', 27, 2048), ('top_15', 17, 2048), ('top_25', 27, 2048))
  m(model, n_features, asked)""",
    "single_class_evaluation": _with(TX, SCORED, EVALUABLE) + """select
  count(*) filter (fraud_score < 0.5) as tn, count(*) filter (fraud_score >= 0.5) as fp,
  cast(0 as bigint) as fn, cast(0 as bigint) as tp, cast(null as double) as precision,
  cast(null as double) as recall, cast(null as double) as f1, cast(0 as bigint) as report_rows,
  cast(null as double) as auc_roc from evaluable where "isFraud" = 0""",
    "stream_dimension_upsert": """select cast(user_id as varchar) as "usuarioID", event_type as usuario,
  value as promedio_de_gastos, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as fecha_nacimiento,
  case when event_id % 2 = 0 then 'mail@host.example' end as email from events
qualify row_number() over (partition by user_id order by event_id desc) = 1""",
    "stream_card_upsert": """select 'CRD-' || cast(user_id as varchar) || '-' || cast(event_id % 2 as varchar) as "tarjetaID",
  cast(user_id as varchar) as "usuarioID", event_type as card4, cast(event_id as int) as card1 from events
qualify row_number() over (partition by user_id, event_id % 2 order by event_id desc) = 1""",
    "stream_fraud_rate": _with(TX) + """select cast(date_trunc('day', fecha_hora_transaccion) as timestamp) as window_start,
  count(*) as n, cast(sum("isFraud") as bigint) as frauds, sum("isFraud") / count(*) as rate from tx
group by date_trunc('day', fecha_hora_transaccion)""",
    "flagship": _with(TX, PROFILES) + f""", rated as (
select *, {ENGINEERED}, {RELATIVE}, {RULE} as rule_score from tx left join profiles using ("usuarioID"))
select "transaccionID", "usuarioID", fecha_hora_transaccion, "TransactionAmt", zscore_amt, velocity,
  amt_distance, ratio_vs_user, zscore_vs_user, rule_score from rated where rule_score >= 0.1
order by rule_score desc, fecha_hora_transaccion desc, "transaccionID" limit 100""",
}

