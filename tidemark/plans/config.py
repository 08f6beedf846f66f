"""Checks of strategy configurations and request parameters, on the driver, before anything runs.

A configuration is a nested dict, as JSON gives it. What a field must be is stated in tables; a check returns all that
is wrong, and a wrong configuration is never completed by defaults.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemark.functions.indicators import PERIODS
from tidemark.functions.timeframes import DURATION_MS
from tidemark.sources.venues import EXCHANGES


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    whole: bool = False
    positive: bool = False
    needed: bool = True

    def wrong(self, v) -> str | None:
        if v is None:
            return "is missing" if self.needed else None
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or abs(v) == float("inf"):
            return "is not a finite number"
        if self.whole and int(v) != v:
            return "is not whole"
        if self.positive and v <= 0 or self.least is not None and v < self.least or self.most is not None and v > self.most:
            return "is out of range"
        return None


PERIOD, SHARE, FACTOR = Number(whole=True, positive=True), Number(0, 100), Number(positive=True)

# The fields of the trend strategy and what they may be.
TREND_FIELDS = {
    "": {"minimumSignalScore": SHARE},
    "weights": dict.fromkeys(("trend", "mediumTrend", "rsi", "macd", "volume"), SHARE),
    "ema": dict.fromkeys(("fast", "medium", "slow"), PERIOD),
    "rsi": {"period": PERIOD} | dict.fromkeys(("longMin", "longMax", "shortMin", "shortMax"), SHARE),
    "macd": dict.fromkeys(("fast", "slow", "signal"), PERIOD) | {"deadZoneRatio": Number(0, 0.1, needed=False)},
    "atr": {"period": PERIOD} | dict.fromkeys(("stopMultiplier", "takeProfit1Multiplier", "takeProfit2Multiplier", "takeProfit3Multiplier"), FACTOR),
    "volume": {"period": PERIOD, "minimumRatio": Number(0)},
    "execution": {"cooldownCandles": Number(0, whole=True)},
    "filters": {"minimumQuoteVolume24h": Number(0)},
}
TREND_FLAGS = {"execution": ("closedCandleOnly",), "filters": ("top500Only",)}
# The fields of the structure strategy, for each of its timeframes.
STRUCTURE_FIELDS = {
    "": {"minimumSignalScore": SHARE}
    | dict.fromkeys(("swingLeft", "swingRight", "internalLeft", "internalRight"), Number(1, 500, whole=True))
    | {"atrPeriod": PERIOD, "eqBand": Number(0, 0.5)}
    | dict.fromkeys(("structureEventFreshBars", "sweepFreshBars", "orderBlockFreshBars", "fvgFreshBars"), Number(0, whole=True)),
    "weights": dict.fromkeys(("swingStructureBias", "recentSwingBos", "internalStructure", "liquiditySweep", "swingOrderBlock", "internalOrderBlock", "fvg", "rangePosition", "confluence"), Number(0, 100, whole=True)),
}


def field_errors(config: object, fields: dict, flags: dict | None = None, closed: bool = False) -> list[str]:
    """What is wrong with single fields. closed: fields that are not listed are wrong too."""
    if not isinstance(config, dict):
        return ["the configuration is no object"]
    errors = []
    for section, numbers in fields.items():
        part = config.get(section) if section else config
        if not isinstance(part, dict):
            errors.append(f"{section}: is no object")
            continue
        errors += [f"{section or 'config'}.{n}: {e}" for n, rule in numbers.items() if (e := rule.wrong(part.get(n)))]
        names = (flags or {}).get(section, ())
        errors += [f"{section}.{n}: is no boolean" for n in names if not isinstance(part.get(n), bool)]
        if closed:
            known = {*numbers, *names} | ({s for s in fields if s} | {"filters"} if not section else set())
            errors += [f"{section or 'config'}.{n}: is unknown" for n in sorted(set(part) - known)]
    return errors


def trend_errors(config: object) -> list[str]:
    errors = field_errors(config, TREND_FIELDS, TREND_FLAGS)
    if errors:
        return errors
    ema, rsi = config["ema"], config["rsi"]
    if sum(config["weights"].values()) <= 0:
        errors.append("weights: their sum is not positive")
    if not ema["fast"] < ema["medium"] < ema["slow"]:
        errors.append("ema: not fast < medium < slow")
    if rsi["longMin"] > rsi["longMax"] or rsi["shortMin"] > rsi["shortMax"]:
        errors.append("rsi: a band is empty")
    return errors


def structure_errors(config: object) -> list[str]:
    """config: a dict of timeframes, each with the fields above and, if wanted, filters, which are the same for all."""
    if not isinstance(config, dict) or not config:
        return ["no timeframe is configured"]
    errors = [f"{t}: is no timeframe" for t in config if t not in DURATION_MS]
    for t, one in config.items():
        wrong = field_errors(one, STRUCTURE_FIELDS, closed=True)
        if not wrong and sum(one["weights"].values()) != 100:
            wrong.append("weights: their sum is not 100")
        errors += [f"{t}: {e}" for e in wrong]
    if not errors and len({repr(one.get("filters")) for one in config.values()}) > 1:
        errors.append("filters differ between timeframes")
    return errors


def periods_of(config: dict) -> dict:
    """The periods of a trend configuration, as indicators take them."""
    return {"ema": tuple(config["ema"][k] for k in ("fast", "medium", "slow")), "rsi": config["rsi"]["period"], "macd": tuple(config["macd"][k] for k in ("fast", "slow", "signal")), "atr": config["atr"]["period"], "volume": config["volume"]["period"]}


def trend_parameters(config: dict) -> dict:
    """What decision.trend_score takes of a checked trend configuration."""
    w, rsi = config["weights"], config["rsi"]
    return {
        "minimum_score": config["minimumSignalScore"], "weights": {"trend": w["trend"], "medium": w["mediumTrend"], "rsi": w["rsi"], "macd": w["macd"], "volume": w["volume"]},
        "rsi_long": (rsi["longMin"], rsi["longMax"]), "rsi_short": (rsi["shortMin"], rsi["shortMax"]), "dead_zone": config["macd"].get("deadZoneRatio") or 0.0, "volume_ratio": config["volume"]["minimumRatio"],
    }


def structure_parameters(config: dict) -> dict:
    """What scoring.score_series takes of one timeframe of a checked structure configuration. A layer is one number where
    its pivots look as far back as ahead, else two."""
    layer = lambda n: config[f"{n}Left"] if config[f"{n}Left"] == config[f"{n}Right"] else (config[f"{n}Left"], config[f"{n}Right"])
    w = config["weights"]
    names = {"swing": "swingStructureBias", "bos": "recentSwingBos", "internal": "internalStructure", "sweep": "liquiditySweep", "swing_block": "swingOrderBlock", "internal_block": "internalOrderBlock", "gap": "fvg", "range": "rangePosition", "overlap": "confluence"}
    fresh = {"bos": config["structureEventFreshBars"], "sweep": config["sweepFreshBars"], "block": config["orderBlockFreshBars"], "gap": config["fvgFreshBars"]}
    return {"swing": layer("swing"), "internal": layer("internal"), "weights": {k: w[n] for k, n in names.items()}, "minimum": config["minimumSignalScore"], "fresh": fresh, "band": config["eqBand"]}


def standard_periods(config: dict) -> bool:
    """Whether snapshots, which have the standard periods, will do."""
    return periods_of(config) == PERIODS


# Parameters of requests. Each returns the value or raises ValueError.


def symbol_param(raw: str | None, longest: int = 32) -> str:
    value = (raw or "").strip().upper()
    if not value or len(value) > longest or not re.fullmatch("[A-Z0-9]+", value):
        raise ValueError("symbol: letters and digits")
    return value


def one_of(raw: str | None, known, upper: bool = False) -> str:
    value = (raw or "").strip()
    value = value.upper() if upper else value
    if value not in known:
        raise ValueError(f"none of {', '.join(known)}")
    return value


def exchange_param(raw: str | None) -> str:
    return one_of(raw, EXCHANGES, upper=True)


def timeframe_param(raw: str | None) -> str:
    return one_of(raw, DURATION_MS)


def limit_param(raw: str | None, default: int = 300, least: int = 50, most: int = 1000) -> int:
    """Strict: nothing is the default, anything but a whole number in the bounds is an error."""
    if raw is None or not raw.strip():
        return default
    try:
        value = float(raw)
    except ValueError:
        value = 0.5
    if value != int(value) or not least <= value <= most:
        raise ValueError(f"limit: a whole number from {least} to {most}")
    return int(value)


def lenient_limit(raw: str | None, default: int = 300, least: int = 50, most: int = 1000) -> int:
    try:
        return limit_param(raw, default, least, most)
    except ValueError:
        return default


def cursor_param(raw: str | None, now_ms: int) -> int | None:
    """A positive time in milliseconds, a day ahead at most; nothing means the newest page."""
    if raw is None or raw == "":
        return None
    if not re.fullmatch("[0-9]+", raw) or not 0 < int(raw) <= now_ms + DURATION_MS["1d"]:
        raise ValueError("before: milliseconds, not from the future")
    return int(raw)


def snapshot_parameters(arguments: list[str]) -> dict:
    """Of a snapshot run: top, timeframes and history from --name=value flags. Unknown or malformed ones are errors;
    --timeframes comes before --timeframe; plan: only what a run would do."""
    known, given = {"top", "timeframe", "timeframes", "history"}, {}
    for a in arguments:
        name, eq, value = a.removeprefix("--").partition("=")
        if a == "--plan":
            continue
        if not a.startswith("--") or not eq or name not in known:
            raise ValueError(f"{a}: is unknown")
        given.setdefault(name, value)

    def whole(name: str, default: int, least: int, most: int) -> int:
        raw = given.get(name)
        if raw is None:
            return default
        if not re.fullmatch("[0-9]+", raw.strip()) or not least <= int(raw) <= most:
            raise ValueError(f"{name}: a whole number from {least} to {most}")
        return int(raw)

    frames = timeframe_list(given["timeframes"]) if "timeframes" in given else timeframe_list(given.get("timeframe", "1h"))[:1]
    return {"top": whole("top", 10, 1, 500), "timeframes": frames, "history": whole("history", 300, 200, 1000), "plan": "--plan" in arguments}


def timeframe_list(raw: str) -> list[str]:
    """Comma-separated timeframes, each once, in their order."""
    return list(dict.fromkeys(timeframe_param(t) for t in raw.split(",")))
