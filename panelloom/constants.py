"""Fixed values. They have to equal the published study and its data vendor codes."""

LOOKBACK_MONTHS = 12
N_PORTFOLIOS = 10
TOP_N = 500
TOP_K = (5, 10, 20, 50, 100, 500)
NEWEY_WEST_LAGS = 12
MONTHS_PER_YEAR = 12
ROLLING_MONTHS = 36
CONFIDENCE = 0.95
MIN_NAMES = 10
VALIDATION_SHARE = 0.30
SEED = 42
ASSUMED_TURNOVER = 0.2
TRADING_COST = 0.001
FORCED_DELISTING_RETURN = -0.30
FORCED_DELISTING_PREFIX = "5"
MAX_MISSING_SHARE = 0.10
OUTLIER_Z = 5.0
MAX_OUTLIER_SHARE = 0.01
CONTROL_GROUPS = 5

# Exchange codes and named universes
NYSE = "N"
UNIVERSES = {
    "crsp_all": ("N", "A", "Q", "P"),
    "crsp_nyse": ("N",),
    "crsp_amex": ("A",),
    "crsp_nasdaq": ("Q", "P"),
}
EXCHANGE_CODES = {"N": 1, "A": 2, "Q": 3, "P": 3, "Z": 3, "C": 3}

# Tokens that mean "missing" in the vendor's text files
NULL_TOKENS = ("", ".", "NA", "NaN")
RETURN_NULL_TOKENS = ("", ".", "NA", "NaN", "C", "B")

# Ordinary shares
SHARE_TYPES = ("NS", "AD")
SECURITY_SUBTYPES = ("COM", "COMAD")

# Expanding estimation windows: (train_end, forecast_start, forecast_end)
EXPANDING_WINDOWS = (
    ("1963-06", "1963-07", "1974-12"),
    ("1974-12", "1975-01", "1984-12"),
    ("1984-12", "1985-01", "1994-12"),
    ("1994-12", "1995-01", "2004-12"),
    ("2004-12", "2005-01", "2014-12"),
    ("2014-12", "2015-01", "2022-12"),
)

# Sub-period fits: (label, train_start, train_end)
SUBPERIOD_FITS = (
    ("192701_196306", "1927-01", "1963-06"),
    ("196307_197412", "1963-07", "1974-12"),
    ("197501_198412", "1975-01", "1984-12"),
    ("198501_199412", "1985-01", "1994-12"),
    ("199501_200412", "1995-01", "2004-12"),
    ("200501_201412", "2005-01", "2014-12"),
)

# Return sub-periods: (label, start, end)
RETURN_SUBPERIODS = (
    ("196307_197412", "1963-07", "1974-12"),
    ("197501_198412", "1975-01", "1984-12"),
    ("198501_199412", "1985-01", "1994-12"),
    ("199501_200412", "1995-01", "2004-12"),
    ("200501_201412", "2005-01", "2014-12"),
    ("201501_202212", "2015-01", "2022-12"),
)

# Factor models
FACTOR_MODELS = {
    "CAPM": ("MKT-RF",),
    "FF3": ("MKT-RF", "SMB", "HML"),
    "FFC4": ("MKT-RF", "SMB", "HML", "UMD"),
    "FFCREV": ("MKT-RF", "SMB", "HML", "UMD", "STR"),
    "FF5": ("MKT-RF", "SMB", "HML", "RMW", "CMA"),
    "Q": ("MKT-RF", "ME", "IA", "ROE"),
}

# Columns of the vendor's monthly file that are dates
VENDOR_DATE_COLUMNS = (
    "SecInfoStartDt", "SecInfoEndDt", "SecurityBegDt", "SecurityEndDt",
    "MthCalDt", "MthPrcDt", "MthPrevDt", "ShrStartDt", "ShrEndDt",
    "DisExDt", "DisDeclareDt", "DisRecordDt", "DisPayDt",
)
# Codes, flags and names that stay text, so that leading zeros are kept
VENDOR_TEXT_COLUMNS = (
    "HdrCUSIP", "HdrCUSIP9", "CUSIP", "CUSIP9",
    "PrimaryExch", "ConditionalType", "ExchangeTier", "TradingStatusFlg",
    "SecurityNm", "ShareClass", "USIncFlg", "IssuerType", "SecurityType",
    "SecuritySubType", "ShareType", "SecurityActiveFlg",
    "DelActionType", "DelStatusType", "DelReasonType", "DelPaymentType",
    "Ticker", "TradingSymbol", "IssuerNm",
    "MthCompFlg", "MthCompSubFlg", "MthPrcFlg", "MthDtFlg", "MthDelFlg",
    "MthVolFlg", "MthFacShrFlg", "ShrSource", "ShrFacType", "ShrAdrFlg",
    "DisOrdinaryFlg", "DisType", "DisFreqType", "DisPaymentType",
    "DisDetailType", "DisTaxType", "DisOrigCurType",
)
VENDOR_KEY_COLUMNS = (
    "PERMNO", "YYYYMM", "MthCalDt", "MthPrc", "MthRet", "MthCap", "ShrOut",
    "PrimaryExch", "USIncFlg", "SecurityType", "MthDelFlg", "DelReasonType", "vwretd",
)
