"""Column and feature contracts, checked on the driver from schemas only."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import DataFrame

from vigil import fixed_values as fv
from vigil.operators.episode_features import episode_formulas

_FEATURE_NAME = re.compile(r"[a-z][a-z0-9_]*")


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def allowlist(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns in this order, once each."""
    ordered = list(dict.fromkeys(names))
    return require_columns(df, ordered).select(*ordered)


def feature_faults(names: list[str]) -> dict[str, list[str]]:
    """What is wrong with a feature list: the names at fault by kind of fault."""
    times = Counter(names)
    faults = {
        "repeated": [n for n in times if times[n] > 1],
        "reserved": [n for n in times if n in fv.NEVER_FEATURES],
        "target": [n for n in times if n.startswith("target_")],
        "malformed": [n for n in times if not _FEATURE_NAME.fullmatch(n)],
    }
    return {kind: found for kind, found in faults.items() if found}


def validate_features(names: list[str]) -> list[str]:
    """The list itself, unless it is empty or any of its names is at fault."""
    faults = feature_faults(names)
    if faults or not names:
        raise ValueError(f"feature list refused: {faults or 'empty'}")
    return names


def panel_feature_names(
    windows: Iterable[int] = fv.PANEL_WINDOWS, active_windows: Iterable[int] = fv.ACTIVE_WINDOWS
) -> list[str]:
    """Names of the panel features for given windows, in contract order."""
    spans = list(windows)
    short, week, month = spans[0], spans[-2], spans[-1]
    counts = [f"{m}_{w}d" for w in spans for m in fv.COUNT_MEASURES]
    numbers = [f"{m}_{w}d" for w in spans for m in fv.NUMERIC_MEASURES]
    extras = [
        *[f"active_days_{w}d" for w in active_windows],
        "hours_since_last_event",
        "history_days",
        f"alarm_rate_{week}d",
        f"event_ratio_{short}d_{week}d",
        f"event_ratio_{week}d_{month}d",
        "dow",
        "month",
        "dow_sin",
        "dow_cos",
        "history_complete_days",
        f"global_complete_days_{short}d",
        f"global_complete_days_{week}d",
    ]
    return counts + numbers + extras


def monthly_feature_names(base: Iterable[str]) -> list[str]:
    """Base features, then those the episode and ratio formulas define, each once."""
    formulas = (episode_formulas(), fv.RATIO_FORMULAS)
    return validate_features(list(dict.fromkeys(chain(base, *formulas))))
