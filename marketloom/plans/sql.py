"""SQL twins of the derived tables, as common table expressions for DuckDB."""

from __future__ import annotations

from marketloom.schemas import VALUES

TRADES = """trades AS (
  SELECT s_nationkey AS nation, l_shipdate AS ts, 100 + 0.27 * l_quantity AS price, l_quantity, l_discount, l_orderkey,
         struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_quantity, f := l_extendedprice) AS line
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

OHLCV = """arg_min(price, line) AS open, max(price) AS high, min(price) AS low, arg_max(price, line) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume, round(avg(l_discount) * 10, 4) AS prob_trade_success"""

BARS = f"""{TRADES},
bars AS (
  SELECT 'N' || lpad(CAST(nation AS VARCHAR), 2, '0') AS symbol, ts, {OHLCV} FROM trades GROUP BY nation, ts)"""

MARKET = f"""{BARS},
market AS (
  SELECT 'SPY' AS symbol, ts, {OHLCV} FROM trades GROUP BY ts
  UNION ALL
  SELECT 'QQQ', ts, {OHLCV} FROM trades
  WHERE nation IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY ts
  UNION ALL
  SELECT '^VIX', ts, v, v, v, v, 0, 0.0 FROM (SELECT ts, 15 + 100 * avg(l_discount) AS v FROM trades
    WHERE dayofyear(ts) % 5 <> 0 GROUP BY ts))"""

RAW = f"""{TRADES},
raw AS (
  SELECT 'N' || lpad(CAST(nation AS VARCHAR), 2, '0') AS symbol, ts,
         row_number() OVER (PARTITION BY nation, ts ORDER BY line) AS row_seq,
         price AS open, price + 1 AS high, CASE WHEN l_orderkey % 89 = 0 THEN 0.0 ELSE price - 1 END AS low,
         CASE WHEN l_orderkey % 97 <> 0 THEN price END AS close,
         CASE WHEN l_orderkey % 83 <> 0 THEN CAST(l_quantity AS BIGINT) END AS volume
  FROM trades)"""

EVENTS = """ev AS (
  SELECT *, CASE WHEN user_id % 10 = 0 THEN 'SPY' ELSE 'U' || CAST(user_id % 10 AS VARCHAR) END AS symbol FROM events),
labelled AS (
  SELECT event_id AS article_id, symbol, ts AS published_at,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS label,
         least(value / 500, 1.0) AS score FROM ev),
articles AS (
  SELECT *, CASE WHEN article_id % 11 <> 0 THEN
         CASE label WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0.0 END END AS finbert_scalar FROM labelled),
hourly AS (
  SELECT symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, arg_min(100 + value / 100, event_id) AS open,
         max(100 + value / 100) AS high, min(100 + value / 100) AS low, arg_max(100 + value / 100, event_id) AS close, count(*) AS volume
  FROM ev GROUP BY symbol, date_trunc('hour', ts))"""


def window_features(source: str) -> str:
    """win: the features that plain frames express, over a table (symbol, ts, open, high, low, close, volume)."""
    frame = lambda n: f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    over = "OVER (PARTITION BY symbol ORDER BY ts)"
    gate = lambda value, n, c="close": f"CASE WHEN count({c}) {frame(n)} >= {n} THEN {value} END"
    first = [f"close / nullif(lag(close, {n}) {over}, 0) - 1 AS return_{n}d" for n in (1, 5, 10, 20)]
    first += [f"{gate(f'avg(close) {frame(n)}', n)} AS sma_{n}" for n in (5, 10, 20, 50, 100, 200)]
    first += [f"lag(close, {n}) {over} AS lag_{n}" for n in (1, 2)]
    first += [f"100 * (close / nullif(lag(close, {n}) {over}, 0) - 1) AS roc_{n}" for n in (5, 10)]
    lo, hi = f"min(low) {frame(14)}", f"max(high) {frame(14)}"
    first += [f"{gate(f'100 * (close - {lo}) / nullif({hi} - {lo}, 0)', 14)} AS stochastic_k"]
    hi, lo = f"max(high) {frame(10)}", f"min(low) {frame(10)}"
    first += [f"{gate(f'(close - {hi}) / nullif({hi}, 0)', 10)} AS close_vs_high_10", f"{gate(f'(close - {lo}) / nullif({lo}, 0)', 10)} AS close_vs_low_10"]
    first += [f"{gate(f'avg(close) {frame(20)}', 20)} AS bb_mavg_20"]
    first += [f"{gate(f'avg(close) {frame(20)} {s} 2 * stddev_pop(close) {frame(20)}', 20)} AS bb_{b}band_20" for b, s in (("h", "+"), ("l", "-"))]
    second = [f"{gate(f'stddev_samp(return_1d) {frame(n)}', n, 'return_1d')} AS volatility_{n}" for n in (5, 10, 20, 50, 100)]
    second += [f"{gate(f'avg(stochastic_k) {frame(3)}', 3, 'stochastic_k')} AS stochastic_d"]
    second += ["100 * (bb_hband_20 - bb_lband_20) / nullif(bb_mavg_20, 0) AS bb_width_20"]
    second += ["(close - bb_lband_20) / nullif(bb_hband_20 - bb_lband_20, 0) AS bb_pband_20"]
    return f"""win1 AS (SELECT symbol, ts, open, high, low, close, volume, {", ".join(first)} FROM {source}),
win2 AS (SELECT *, {", ".join(second)} FROM win1),
win AS (SELECT *, volatility_20 / nullif(volatility_50, 0) AS volatility_ratio FROM win2)"""


def smoothing(source: str) -> str:
    """smooth: exponential features by recursion over the row number. Needs WITH RECURSIVE."""
    spans = (10, 20, 50, 100, 200)
    start = ["close AS e12", "close AS e26", *(f"close AS n{s}, CAST(1 AS DOUBLE) AS d{s}" for s in spans)]
    start += [f"CAST(0 AS DOUBLE) AS up{n}, CAST(0 AS DOUBLE) AS dn{n}" for n in (14, 21)]
    start += ["CAST(NULL AS DOUBLE) AS sig", "high - low AS trsum", "CAST(0 AS DOUBLE) AS atr"]
    step = [f"r.e{s} + {2 / (s + 1)!r} * (b.close - r.e{s})" for s in (12, 26)]
    step += [f"r.n{s} * {1 - 2 / (s + 1)!r} + b.close, r.d{s} * {1 - 2 / (s + 1)!r} + 1" for s in spans]
    for n in (14, 21):
        step += [f"r.up{n} + (greatest(b.close - r.close, 0) - r.up{n}) / {n}", f"r.dn{n} + (greatest(r.close - b.close, 0) - r.dn{n}) / {n}"]
    macd = f"((r.e12 + {2 / 13!r} * (b.close - r.e12)) - (r.e26 + {2 / 27!r} * (b.close - r.e26)))"
    tr = "greatest(b.high - b.low, abs(b.high - r.close), abs(b.low - r.close))"
    step += [f"CASE WHEN b.rn < 26 THEN NULL WHEN b.rn = 26 THEN {macd} ELSE r.sig + 0.2 * ({macd} - r.sig) END"]
    step += [f"r.trsum + {tr}", f"CASE WHEN b.rn < 14 THEN 0 WHEN b.rn = 14 THEN (r.trsum + {tr}) / 14 ELSE (r.atr * 13 + {tr}) / 14 END"]
    out = [f"n{s} / d{s} AS ema_{s}" for s in spans]
    out += [f"CASE WHEN rn >= {n} THEN CASE WHEN dn{n} = 0 THEN 100 ELSE 100 - 100 / (1 + up{n} / dn{n}) END END AS rsi_{n}" for n in (14, 21)]
    out += ["CASE WHEN rn >= 26 THEN e12 - e26 END AS macd", "CASE WHEN rn >= 34 THEN sig END AS macd_signal", "atr AS atr_14"]
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {source}),
walk AS (
  SELECT symbol, ts, rn, close, {", ".join(start)} FROM numbered WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.ts, b.rn, b.close, {", ".join(step)} FROM walk r JOIN numbered b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
smooth1 AS (SELECT symbol, ts, {", ".join(out)} FROM walk),
smooth AS (SELECT *, ema_20 / lag(ema_20, 5) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ema_slope_20 FROM smooth1)"""


def features(source: str) -> str:
    """features: complete feature rows. Needs WITH RECURSIVE."""
    return f"""{window_features(source)},
{smoothing(source)},
joined AS (SELECT win.*, smooth.* EXCLUDE (symbol, ts),
  CASE WHEN coalesce(ema_20 > sma_50 AND ema_50 > ema_100, false) THEN 1.0 ELSE 0.0 END AS ema_trend_bull
  FROM win JOIN smooth USING (symbol, ts)),
features AS (SELECT symbol, ts, {", ".join(VALUES)} FROM joined WHERE {" AND ".join(f"{c} IS NOT NULL" for c in VALUES)})"""


def z_scores(source: str = "features") -> str:
    """scores: row z-scores of the source's values."""
    values = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in VALUES) + "]"
    return f"""moments AS (SELECT *, list_avg({values}) AS mean_, coalesce(nullif(list_stddev_pop({values}), 0), 1) AS sd_ FROM {source}),
scores AS (SELECT symbol, ts, {", ".join(f"({c} - mean_) / sd_ AS {c}_z" for c in VALUES)} FROM moments)"""


def rounded(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)
