"""SQL for the problems that SQL can state. Units and spikes need more; they are tested against brute force."""

WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF41 + i) for i in range(26))
NARROW = "0123456789abcdefghijklmnopqrstuvwxyz"


def code_ctes(name: str, source: str, extra: str) -> str:
    """CTEs ending in `name`: the rows of source with column nc, the code in normal form."""
    return f"""
{name}_a AS (SELECT {extra}, code AS raw_code, regexp_replace(translate(lower(code), '{WIDE}', '{NARROW}'), '[^a-z0-9]', '', 'g') AS c FROM {source}),
{name}_b AS (SELECT * EXCLUDE (c), CASE WHEN length(c) = 8 AND right(c, 2) IN ('sh', 'sz', 'bj') THEN right(c, 2) || left(c, 6) ELSE c END AS c FROM {name}_a),
{name}_c AS (SELECT * EXCLUDE (c), CASE WHEN regexp_matches(translate(c, 'oil', '011'), '^([0-9]+$|sh|sz|bj)') THEN translate(c, 'oil', '011') ELSE c END AS c FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN regexp_matches(c, '^(sh|sz|bj)') THEN NULL ELSE regexp_replace(c, '[^0-9]', '', 'g') END AS dg FROM {name}_c),
{name} AS (SELECT * EXCLUDE (c, dg), CASE
  WHEN regexp_full_match(c, '(sh|sz|bj)[0-9]{{6}}') THEN c
  WHEN length(dg) <> 6 THEN NULL
  WHEN regexp_matches(dg, '^(6|9|51|56|58)') THEN 'sh' || dg
  WHEN regexp_matches(dg, '^(0|3|15|16|18)') THEN 'sz' || dg
  WHEN regexp_matches(dg, '^[48]') THEN 'bj' || dg END AS nc FROM {name}_d)"""


def day_of(text: str) -> str:
    t = f"translate({text}, '{WIDE}', '{NARROW}')"
    split = r"'^[^0-9]*([0-9]{4})[-/.年\s]+([0-9]{1,2})[-/.月\s]+([0-9]{1,2})([^0-9]|$)'"
    solid = r"'^[^0-9]*([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{4}|[0-9]{6})?([^0-9]|$)'"
    part = lambda k: f"coalesce(nullif(regexp_extract({t}, {split}, {k}), ''), nullif(regexp_extract({t}, {solid}, {k}), ''))"
    return f"try_cast({part(1)} || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(3)}, 2, '0') AS date)"


CAL = """
cal AS (SELECT cast(cal_day AS date) AS cal, max(CASE WHEN is_open THEN cast(cal_day AS date) END) OVER (ORDER BY cal_day ROWS UNBOUNDED PRECEDING) AS day FROM trade_days)"""
BARS = f"""{code_ctes("nb", "daily_bars", "bar_id, src, date")},
rb AS (SELECT bar_id, src, nc AS code, raw_code, {day_of("date")} AS rd FROM nb),{CAL},
b AS (SELECT rb.*, cal.day FROM rb LEFT JOIN cal ON cal.cal = CASE WHEN rb.rd IS NOT NULL THEN least(rb.rd, (SELECT max(cal) FROM cal)) END)"""
RANGES = "r AS (SELECT src, code, min(day) AS a, max(day) AS z FROM b WHERE code IS NOT NULL AND day IS NOT NULL GROUP BY ALL), s AS (SELECT DISTINCT src, code, day FROM b WHERE code IS NOT NULL AND day IS NOT NULL)"
STOCKS = f"""{code_ctes("ns", "stocks", "snap_id, industry, tier, mktcap, updated, loaded_at")},
st AS (SELECT nc AS code, {day_of("updated")} AS day, lower(trim(industry)) AS industry, lower(trim(tier)) AS tier, mktcap, loaded_at, snap_id FROM ns WHERE nc IS NOT NULL)"""
VERSIONS = f"""WITH {STOCKS},
one AS (SELECT * FROM st WHERE day IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code, day ORDER BY loaded_at DESC, snap_id DESC) = 1),
f AS (SELECT code, day, last_value(industry IGNORE NULLS) OVER w AS industry, last_value(tier IGNORE NULLS) OVER w AS tier, last_value(mktcap IGNORE NULLS) OVER w AS mktcap FROM one WINDOW w AS (PARTITION BY code ORDER BY day ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, lag(industry) OVER v AS pi, lag(tier) OVER v AS pt, lag(mktcap) OVER v AS pm, row_number() OVER v AS i FROM f WINDOW v AS (PARTITION BY code ORDER BY day)),
h AS (SELECT * FROM g WHERE i = 1 OR pi IS DISTINCT FROM industry OR pt IS DISTINCT FROM tier OR pm IS DISTINCT FROM mktcap)
"""
ORPHANS = f"""WITH {BARS},{code_ctes("na", "adjust", "adj_id, ts")},{code_ctes("nd", "delisted", "dl_id, last_date")},{STOCKS},
kn AS (SELECT code, min(day) AS since FROM st GROUP BY ALL), go AS (SELECT nc AS code, max({day_of("last_date")}) AS upto FROM nd WHERE nc IS NOT NULL GROUP BY ALL),
al AS (SELECT 'daily_bars' AS tab, bar_id AS row_id, code, raw_code, day FROM b UNION ALL SELECT 'adjust', adj_id, nc, raw_code, DATE '1970-01-01' + cast(floor(ts / 86400) AS integer) FROM na UNION ALL SELECT 'delisted', dl_id, nc, raw_code, {day_of("last_date")} FROM nd),
o AS (SELECT tab, row_id, al.day, CASE WHEN kn.code IS NULL THEN 'no such key' WHEN al.day < since THEN 'not yet' WHEN al.day > upto AND kn.code IS NOT NULL THEN 'closed' END AS why FROM al LEFT JOIN kn ON al.code = kn.code LEFT JOIN go ON al.code = go.code WHERE raw_code IS NOT NULL)
"""

SQL = {
    "p1_found": f"""WITH {BARS}, {RANGES}
SELECT r.src, r.code, strftime(o.day, '%Y-%m-%d') AS trade_day FROM r JOIN (SELECT DISTINCT day FROM cal) o ON o.day BETWEEN r.a AND r.z LEFT JOIN s ON s.src = r.src AND s.code = r.code AND s.day = o.day WHERE s.day IS NULL""",
    "p3_found": f"""WITH {BARS}, {RANGES},
c AS (SELECT r.src, r.code, cal.cal FROM r JOIN cal ON cal.cal BETWEEN r.a AND r.z)
SELECT c.src, c.code, strftime(c.cal, '%Y-%m-%d') AS cal_day FROM c ASOF LEFT JOIN s ON s.src = c.src AND s.code = c.code AND s.day <= c.cal WHERE c.cal - s.day >= 7""",
    "p5_found": VERSIONS + "SELECT code, strftime(day, '%Y-%m-%d') AS valid_from FROM h",
    "p5_history": VERSIONS + "SELECT code, strftime(day, '%Y-%m-%d') AS valid_from, strftime(lead(day) OVER (PARTITION BY code ORDER BY day) - INTERVAL 1 DAY, '%Y-%m-%d') AS valid_to, industry, tier, mktcap FROM h",
    "p6_found": ORPHANS + "SELECT tab, row_id FROM o WHERE why IS NOT NULL",
    "p6_report": ORPHANS + "SELECT tab, coalesce(strftime(day, '%Y-%m'), 'none') AS period, why, count(*) AS n FROM o WHERE why IS NOT NULL GROUP BY ALL",
}
