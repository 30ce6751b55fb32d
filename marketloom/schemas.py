"""Column lists shared by all modules (fixed values: names and order are part of the data model)."""

from __future__ import annotations

KEY = ["symbol", "ts"]
PRICES = ["open", "high", "low", "close", "volume"]

#: The base features of a bar, in the order of the model vector (fixed values).
FEATURES = [
    "open", "high", "low", "volume", "return_1d", "return_5d", "return_10d", "return_20d",
    "sma_5", "sma_10", "sma_20", "sma_50", "sma_100", "ema_10", "ema_20", "ema_50",
    "ema_100", "volatility_5", "volatility_10", "volatility_20", "volatility_50", "volatility_100", "lag_1", "lag_2",
    "sma_200", "ema_200", "ema_trend_bull", "ema_slope_20", "rsi_14", "rsi_21", "macd", "macd_signal",
    "roc_5", "roc_10", "stochastic_k", "stochastic_d", "atr_14", "volatility_ratio", "close_vs_high_10", "close_vs_low_10",
    "bb_mavg_20", "bb_hband_20", "bb_lband_20", "bb_width_20", "bb_pband_20",
]
#: What a stored feature row must hold, and what the row z-score runs over.
VALUES = ["close", *FEATURES]

#: Features of a market index that bars get as context, and of the volatility index (fixed values).
INDEX_CONTEXT = ["return_1d", "return_5d", "volatility_20", "sma_20", "ema_trend_bull", "ema_slope_20"]
CONTEXT = [
    "spy_return_1d_z", "spy_return_5d_z", "spy_volatility_20_z", "spy_sma_20_z", "spy_ema_trend_bull_z", "spy_ema_slope_20_z", "spy_return_5d_z_minus_1d_z",
    "qqq_return_1d_z", "qqq_return_5d_z", "qqq_volatility_20_z", "qqq_sma_20_z", "qqq_ema_trend_bull_z", "qqq_ema_slope_20_z", "qqq_return_5d_z_minus_1d_z",
    "vix_level_z", "vix_change_z", "vix_return_5d_z", "vix_volatility_20_z", "vix_sma_20_z", "vix_high_vol_z",
]
#: The news columns of the model vector (fixed values).
SENTIMENT = [
    "sym_sentiment_d1", "sym_news_volume_d1", "sym_sentiment_vol_d1",
    "spy_sentiment_d1", "spy_news_volume_d1", "spy_sentiment_vol_d1",
]
#: All sentiment columns that a bar carries (fixed values); the first ones are not in the model vector.
SENTIMENT_ALL = [
    "news_sentiment_mean_z", "sentiment_1h", "sentiment_24h", "sentiment_3d", "news_volume", "sentiment_volatility",
    "sym_sentiment_d1", "sym_news_volume_d1", "sym_sentiment_vol_d1", "spy_sentiment_d1", "spy_news_volume_d1", "spy_sentiment_vol_d1",
]
TARGET = "trade_success"


def z(columns: list[str]) -> list[str]:
    return [f"{c}_z" for c in columns]


#: The model vector: 45 row z-scores, 20 context and 6 sentiment columns.
MODEL_VECTOR = [*z(FEATURES), *CONTEXT, *SENTIMENT]

#: The market indices (fixed values).
MARKETS = ["QQQ", "SPY", "^VIX"]
#: Take profit, stop loss, bars that a trade is held and the default signal threshold (fixed values).
TAKE_PROFIT, STOP_LOSS, HOLD, THRESHOLD = 0.08, 0.04, 15, 0.33

#: Columns of a chart's history (fixed values).
CHART = [
    "ts", "open", "high", "low", "close", "volume", "ema_10", "ema_20", "sma_20", "rsi_14", "macd", "macd_signal",
    "bb_mavg_20", "bb_hband_20", "bb_lband_20", "bb_width_20", "bb_pband_20",
]
