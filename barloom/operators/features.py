"""Session, volatility and basis features, and the feature-name classifier."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions.columns import EPS, non_negative, safe_div
from barloom.operators.ordered import BARS, Layout, framed, lagged, rolling_sums
from barloom.operators.profiles import HALF_LIVES
from barloom.operators.resample import align_to_base, complete_bars

# ---- exchange sessions -----------------------------------------------------------------------


@dataclass(frozen=True)
class Session:
    name: str
    start: int          # minute of the local day
    end: int
    zone: str
    turnover: float
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)  # Monday = 0

    @property
    def weight(self) -> float:
        return math.log1p(self.turnover / (self.end - self.start)) if self.turnover > 0 else 0.0


# Local opening minutes, time zone and average turnover of each session.
SESSIONS = {s.name: s for s in [
    Session("NYSE", 9 * 60 + 30, 16 * 60, "America/New_York", 36027392),
    Session("Xetra", 9 * 60, 17 * 60 + 30, "Europe/Berlin", 1598603),
    Session("TSE_Morning", 9 * 60, 11 * 60 + 30, "Asia/Tokyo", 4975573),
    Session("TSE_Afternoon", 12 * 60 + 30, 15 * 60 + 30, "Asia/Tokyo", 5970688),
    Session("SSE_Morning", 9 * 60 + 30, 11 * 60 + 30, "Asia/Shanghai", 9569137),
    Session("SSE_Afternoon", 13 * 60, 15 * 60, "Asia/Shanghai", 9569137),
    Session("BSE", 9 * 60 + 15, 15 * 60 + 30, "Asia/Kolkata", 140737),
    Session("ASX", 10 * 60, 16 * 60, "Australia/Sydney", 977696),
    Session("HOSE_Morning", 9 * 60 + 15, 11 * 60 + 30, "Asia/Ho_Chi_Minh", 135064),
    Session("HOSE_Afternoon", 13 * 60, 14 * 60 + 30, "Asia/Ho_Chi_Minh", 90043),
    Session("PSE_Morning", 9 * 60 + 30, 12 * 60, "Asia/Manila", 11878),
    Session("PSE_Afternoon", 13 * 60, 14 * 60 + 45, "Asia/Manila", 8315),
    Session("PSX", 9 * 60 + 32, 15 * 60 + 30, "Asia/Karachi", 35793),
    Session("SET_Morning", 10 * 60, 12 * 60 + 30, "Asia/Bangkok", 96693),
    Session("SET_Afternoon", 14 * 60, 16 * 60 + 30, "Asia/Bangkok", 96693),
    Session("IDX", 9 * 60, 15 * 60 + 50, "Asia/Jakarta", 145719),
    Session("DFM", 10 * 60, 15 * 60, "Asia/Dubai", 34152),
    Session("NSE_Nigeria", 10 * 60, 14 * 60 + 20, "Africa/Lagos", 2526),
    Session("BIST_Morning", 9 * 60 + 30, 12 * 60 + 30, "Europe/Istanbul", 379348),
    Session("BIST_Afternoon", 14 * 60, 17 * 60 + 30, "Europe/Istanbul", 442573),
    Session("NSE_Kenya", 9 * 60, 15 * 60, "Africa/Nairobi", 733),
    Session("B3", 10 * 60, 16 * 60 + 55, "America/Sao_Paulo", 780526),
    Session("BCBA", 10 * 60 + 30, 17 * 60, "America/Argentina/Buenos_Aires", 1742627),
    Session("BVC", 9 * 60 + 30, 15 * 60 + 55, "America/Bogota", 7363),
]}
IMPULSE_MINUTES = 30.0


def session_columns(s: Session, time: str = "ts") -> dict[str, Column]:
    local = F.from_utc_timestamp(time, s.zone)
    minute = F.hour(local) * 60 + F.minute(local)
    active = F.weekday(local).isin(*s.weekdays) & (minute >= s.start) & (minute < s.end)

    def value(decay: Column | None) -> Column:
        v = F.lit(s.weight) if decay is None else F.lit(s.weight) * F.exp(-decay / IMPULSE_MINUTES)
        return F.when(active, v).otherwise(0.0)

    return {f"session_flow_{s.name}": value(None), f"session_open_impulse_{s.name}": value(minute - s.start),
            f"session_close_impulse_{s.name}": value(F.lit(s.end) - minute)}


def session_features(df: DataFrame, names: list[str] | None = None, time: str = "ts") -> DataFrame:
    """Flow and decaying open / close impulses of each exchange session; row-wise, no shuffle."""
    chosen = list(SESSIONS) if names is None else names
    unknown = [n for n in chosen if n not in SESSIONS]
    if unknown:
        raise ValueError(f"unknown sessions: {unknown}")
    cols: dict[str, Column] = {}
    for n in chosen:
        cols.update(session_columns(SESSIONS[n], time))
    return df.withColumns(cols)


def latest_session_features(df: DataFrame, names: list[str] | None = None, layout: Layout = BARS) -> DataFrame:
    last = df.groupBy(*layout.key).agg(F.max(layout.time).alias(layout.time))
    return session_features(last, names, layout.time)


# ---- realized volatility ----------------------------------------------------------------------

VOL_WINDOWS = (1, 5, 15, 60, 240)
VOL_PAIRS = ((1, 5), (5, 15), (15, 60), (60, 240))


def guard_prices(df: DataFrame, col: str = "close") -> DataFrame:
    """Only rows with a finite positive price."""
    c = F.col(col)
    return df.where(c.isNotNull() & ~F.isnan(c) & (c > 0) & (c != float("inf")))


def assert_prices(df: DataFrame, col: str = "close") -> DataFrame:
    c = F.col(col)
    ok = F.coalesce(~F.isnan(c) & (c > 0) & (c != float("inf")), F.lit(False))
    return df.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"{col} must be finite and positive")).cast("boolean")))


def volatility_features(df: DataFrame, windows=VOL_WINDOWS, layout: Layout = BARS, eps: float = EPS) -> DataFrame:
    """Realized volatility, its up and down parts, and vol-of-vol per window; NULL until the window is full."""
    def build(f, w):
        f = f.withColumn("_r", F.ln(F.col("close") / F.lag("close", 1).over(w)))
        r2 = F.col("_r") * F.col("_r")
        parts = {"s": r2, "u": F.when(F.col("_r") <= 0, 0.0).otherwise(r2), "d": F.when(F.col("_r") >= 0, 0.0).otherwise(r2),
                 "q": r2 * r2}
        f = rolling_sums(f, w, {f"_{k}{n}": (c, n) for n in windows for k, c in parts.items()})
        out = []
        for n in windows:
            full = F.col("_i") >= n
            m = {k: non_negative(F.col(f"_{k}{n}") / n) for k in parts}
            out += [F.when(full, F.sqrt(m["s"])).alias(f"rv_{n}"), F.when(full, F.sqrt(m["u"])).alias(f"rv_up_{n}"),
                    F.when(full, F.sqrt(m["d"])).alias(f"rv_down_{n}"),
                    F.when(full, F.sqrt(non_negative(m["q"] - m["s"] * m["s"])) / (m["s"] + eps)).alias(f"vov_{n}")]
        return f.select("*", *out).drop("_r", *[f"_{k}{n}" for n in windows for k in parts])

    return framed(df, build, layout, back=max(windows) + 1)


def compression_features(df: DataFrame, pairs=VOL_PAIRS, eps: float = EPS) -> DataFrame:
    return df.withColumns({f"rv_ratio_{a}_{b}": F.ln((F.col(f"rv_{a}") + eps) / (F.col(f"rv_{b}") + eps)) for a, b in pairs})


# ---- futures / index basis ---------------------------------------------------------------------

def _futures_like(name: str, index_close: str) -> bool:
    low = name.strip().lower()
    if name == index_close or any(x in low for x in ("volume", "time")) or "close" not in low:
        return False
    return re.search(r"(^|[^a-z0-9])um([^a-z0-9]|$)", low) is not None


def futures_close_column(columns: list[str], index_close: str = "close", configured: str = "") -> str:
    """The configured column, else the only safe candidate."""
    if configured:
        if configured.lower() == "volume" or configured not in columns or configured == index_close:
            raise ValueError(f"unusable futures close column: {configured}")
        return configured
    found = [c for c in columns if _futures_like(c, index_close)]
    if len(found) != 1:
        raise ValueError(f"need exactly one futures close candidate, found {found}")
    return found[0]


def basis_columns(index: Column, futures: Column) -> Column:
    return safe_div(futures, index) - 1


def basis_features(df: DataFrame, futures: str, index: str = "close", layout: Layout = BARS) -> DataFrame:
    """Relative basis, its magnitude and its change to the previous row."""
    d = df.withColumn("basis_rel", basis_columns(F.col(index), F.col(futures)))
    d = lagged(d, {"_pb": ("basis_rel", 1)}, layout)
    return d.withColumns({"basis_abs": F.abs("basis_rel"), "basis_change": F.col("basis_rel") - F.col("_pb")}).drop("_pb")


def interval_basis(df: DataFrame, label: str, base_seconds: int, futures: str, index: str = "close",
                   layout: Layout = BARS) -> DataFrame:
    """Basis at the close of complete coarse buckets, seen from base rows."""
    coarse = complete_bars(df, label, base_seconds, key=layout.key,
                           aggs=[F.max_by(index, F.when(F.col(index).isNotNull(), F.col("ts"))).alias("_ix"),
                                 F.max_by(futures, F.when(F.col(futures).isNotNull(), F.col("ts"))).alias("_fu")])
    b = basis_features(coarse.where(F.col("_ix").isNotNull() & F.col("_fu").isNotNull()), "_fu", "_ix", layout)
    names = {k: f"{k}_{label}" for k in ("basis_rel", "basis_abs", "basis_change")}
    b = b.withColumnsRenamed(names)
    return align_to_base(df, b, list(names.values()), layout)


# ---- feature names -----------------------------------------------------------------------------

_HORIZONS = "|".join(HALF_LIVES)
# Fixed patterns: which family a feature name belongs to, first match wins.
FAMILIES = [
    ("raw", r"^(open|high|low|close|volume)$"),
    ("streak", r"^(candle_)?streak_"),
    ("candle", r"^(\d+[a-z]+_)?(candle_|cdl_)"),
    ("session", r"^session_(flow|open_impulse|close_impulse)_"),
    ("volatility", r"^(rv|rv_up|rv_down|vov|rv_ratio)_\d"),
    ("volume_profile", rf"^vp_({_HORIZONS})_"),
    ("reaction_profile", rf"^rp_({_HORIZONS})_"),
    ("basis", r"^(futures_index_)?basis_(rel|abs|change)"),
    ("indicator", r"_fit_"),
]


def classify_features(names: DataFrame, col: str = "feature") -> DataFrame:
    """Family of each feature name; names that look like a profile or basis family but do not parse fail."""
    family = F.lit("unclassified")
    for label, pattern in reversed(FAMILIES):
        family = F.when(F.col(col).rlike(pattern), label).otherwise(family)
    typo = (family == "unclassified") & F.col(col).rlike(r"^(vp_|rp_|futures_index_basis_)")
    return names.withColumn("family", F.when(typo, F.raise_error(F.concat(F.lit("unknown feature "), F.col(col)))).otherwise(family))
