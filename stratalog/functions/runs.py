"""Column functions on runs: outcomes, durations, machine prices and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A runner label's first matching part sets its price.
MULTIPLIERS = (("macos", 10), ("windows", 2), ("ubuntu", 1), ("linux", 1))
# Outcomes by the words of the API.
OUTCOMES = {
    "success": "success",
    "neutral": "success",
    "skipped": "success",
    "failure": "failure",
    "startup_failure": "failure",
    "action_required": "failure",
    "cancelled": "cancelled",
    "timed_out": "timed_out",
}
NOT_OUR_CODE = ("infrastructure", "resource", "timeout")
COMMIT_KEY = ["repo", "workflow", "job", "commit"]


def runner_multiplier(runner: Column) -> Column:
    label, out = F.lower(runner), F.lit(1)
    for part, price in reversed(MULTIPLIERS):
        out = F.when(label.contains(part), price).otherwise(out)
    return out.cast("long")


def outcome(conclusion: Column) -> Column:
    """The outcome of an API conclusion; an unfinished or unknown one is an error."""
    out = F.when(conclusion.isNull(), F.raise_error(F.lit("run is still in progress")).cast("string"))
    for word, kind in OUTCOMES.items():
        out = out.when(conclusion == word, kind)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown conclusion: "), conclusion)).cast("string"))


def duration_micros(started: Column, completed: Column) -> Column:
    """Never negative, in exact microseconds."""
    return F.greatest(F.lit(0).cast("long"), F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp")))


def failed(conclusion: Column) -> Column:
    return conclusion != "success"


def label(run_id: Column, attempt: Column) -> Column:
    return F.concat_ws("#", run_id, attempt.cast("string"))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _one_decimal(x: Column) -> Column:
    """A positive double with one decimal, rounded by its exact binary value, halves to the even digit."""
    t = F.floor(x * 10 - F.when(F.floor(x * 10) / 10 > x, 1).otherwise(0))
    tie = (t + 0.5) / 10
    # the exact remainder of the double next to the tie: its halves times twenty are exact
    high = tie * 134217729.0 - (tie * 134217729.0 - tie)
    beyond = (high * 20 - (2 * t + 1)) + (tie - high) * 20
    up = (x > tie) | ((x == tie) & ((beyond > 0) | ((beyond == 0) & (t % 2 == 1))))
    tenths = (t + up.cast("long")).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_duration(seconds: Column) -> Column:
    """Whole seconds below a minute, whole minutes below 90, else hours; halves go to the even digit."""
    s = seconds.cast("double")
    return (
        F.when(s < 60, F.concat(F.bround(s).cast("long").cast("string"), F.lit("s")))
        .when(s / 60 < 90, F.concat(F.bround(s / 60).cast("long").cast("string"), F.lit("m")))
        .otherwise(F.concat(_one_decimal(s / 3600), F.lit("h")))
    )


def shorten(text: Column, width: int, mark: str = "...") -> Column:
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.char_length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - len(mark)), F.lit(mark)))
