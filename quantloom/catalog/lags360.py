"""360 lag factors: six fields 0 to 59 rows back, prices over the close and volume over the volume of the day."""

from __future__ import annotations

from quantloom.functions.expr import Expr, delay, div, field

LAGS = 60
FIELDS = ("close", "open", "high", "low", "vwap", "volume")


def factors() -> dict[str, Expr]:
    out = {}
    for name in FIELDS:
        base = field("volume" if name == "volume" else "close") + 1e-12
        for k in range(LAGS):
            out[f"{name.upper()}{k}"] = div(delay(field(name), k), base)
    return out
