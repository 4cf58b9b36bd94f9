"""Fixed values that results depend on."""
from __future__ import annotations

# --- fixed values: scoring model -------------------------------------------------------------------------
FACTORS = ("value", "quality", "growth", "safety", "momentum")
REQUIRED_FACTORS = ("value", "quality")
MIN_FACTORS = 3
SHRINKAGE_K = 5
AFTER_TAX = 0.78
ONEOFF_RATIO = 1.2
FISCAL_GAP_DAYS = 182
DEFAULT_PRESET = "balanced"
MODEL_VERSION = "bourseflow-1"

# metric -> (factor, direction, weight inside the factor, penalty only, neutralised by theme)
METRICS = {
    "conservative_yield": ("value", 1, 1, False, False),
    "book_yield": ("value", 1, 1, False, True),
    "trap_signal": ("value", 1, 1, True, False),
    "return_on_assets": ("quality", 1, 1, False, True),
    "operating_margin": ("quality", 1, 1, False, True),
    "revenue_cagr2": ("growth", 1, 1, False, True),
    "profit_growth2": ("growth", 1, 1, False, True),
    "volatility": ("safety", -1, 2, False, False),
    "liab_assets": ("safety", -1, 1, False, False),
    "momentum": ("momentum", 1, 1, False, True),
}

# preset -> weights in the order of FACTORS
PRESETS = {
    "aggressive": (0.05, 0.10, 0.35, 0.10, 0.40),
    "growth": (0.10, 0.20, 0.40, 0.05, 0.25),
    "balanced": (0.20, 0.20, 0.20, 0.20, 0.20),
    "value": (0.40, 0.20, 0.10, 0.20, 0.10),
}
PRESET_ORDER = {"aggressive": 1, "growth": 2, "balanced": 3, "value": 4}

# --- fixed values: rational approximation of the normal quantile (P. J. Acklam) -------------------------
QUANTILE_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
              6.680131188771972e+01, -1.328068155288572e+01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
              -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
QUANTILE_LOW = 0.02425

# --- fixed values: market mood and condition -----------------------------------------------------------
MOOD_LABELS = ((20, "극단적 공포"), (40, "공포"), (60, "중립"), (80, "탐욕"))
MOOD_TOP = "극단적 탐욕"
INSUFFICIENT = "데이터 부족"
BAND_LABELS = ("매우 낮음", "낮음", "보통", "높음", "매우 높음")
RANGE_DAYS, MA_DAYS, RSI_DAYS = 252, 125, 14
VIX_HIGH, VIX_LOW, VIX_MAX_LAG = 35.0, 12.0, 5
MOOD_LOOKBACK = RANGE_DAYS + 10
MOOD_VERSION = 1
MIN_SECTOR_SAMPLE = 5
MAX_MOOD_LAG = 5

# --- fixed values: reasons written to the quarantine ----------------------------------------------------
BAD_UNFINISHED = "장 마감 전 미확정 봉"
BAD_NO_CLOSE = "종가 결측"
BAD_NO_OHLCV = "OHLCV 결측"
BAD_PRICE = "가격 0 이하(거래정지 등)"
BAD_HIGH_LOW = "고가 < 저가"
BAD_VOLUME = "음수 거래량"
BAD_UNKNOWN = "unknown natural key"
BAD_NUMBER = "number beyond the column"
BAD_FX = "환율 결측/0 이하"

# --- fixed values: ingestion rules ----------------------------------------------------------------------
MARKET_CLOSE = {"Asia/Seoul": "15:30:00", "America/New_York": "16:00:00"}
DATA_CUTOFF = {"KR": ("Asia/Seoul", "18:00:00"), "US": ("America/New_York", "17:00:00")}
ADJUST_TOLERANCE = 0.005
FX_WINDOW, FX_MAX_DEVIATION = 5, 0.05
PERIODIC_REPORTS = ("정기공시", "10-K", "10-K/A", "10-Q", "10-Q/A")
ANNUAL_FORMS = ("10-K", "10-K/A")
QUARTER_FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A")
FEED_SKIP_PREFIXES = ("[첨부추가]", "[첨부정정]")
ANNUAL_REPORT_WORD = "사업보고서"
QUARANTINE_NOTE = "격리 ([0-9]+)행"
GUEST_PREFIX = "게스트-"
