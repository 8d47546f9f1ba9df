"""The study: dated windows, event/baseline pairs, a target and a control group."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The month-day spans of an event study, inclusive at both ends.
EVENT_SPANS = (
    ("pre", (4, 1), (5, 20)),
    ("during", (5, 21), (5, 24)),
    ("post", (5, 25), (6, 15)),
)
BASELINE_PREFIX = "baseline_"

# Labels of rows no window takes.
OUTSIDE = "outside"
UNKNOWN = "unknown"


@dataclass(frozen=True)
class WindowSpan:
    """One labelled range of days, both ends inclusive."""

    label: str
    start: date
    end: date


@dataclass(frozen=True)
class StudyDesign:
    """Windows and pairs are configuration held by the driver, never data."""

    windows: tuple[WindowSpan, ...]
    pairs: tuple[tuple[str, str], ...]
    target: str
    control: str
    event_year: str
    baseline_year: str

    @classmethod
    def two_years(cls, target: str, control: str, event_year: int, baseline_year: int,
                  spans=EVENT_SPANS) -> "StudyDesign":
        """The same month-day spans in the event year and in the baseline year."""
        windows, pairs = [], []
        for prefix, year in (("", event_year), (BASELINE_PREFIX, baseline_year)):
            for label, start, end in spans:
                windows.append(WindowSpan(prefix + label, date(year, *start), date(year, *end)))
        for label, _, _ in spans:
            pairs.append((label, BASELINE_PREFIX + label))
        return cls(tuple(windows), tuple(pairs), target, control, str(event_year), str(baseline_year))

    @property
    def event_labels(self) -> list[str]:
        return [event for event, _ in self.pairs]

    @property
    def baseline_labels(self) -> list[str]:
        return [baseline for _, baseline in self.pairs]

    @property
    def paired_labels(self) -> list[str]:
        return self.event_labels + self.baseline_labels

    def assign(self, day: Column | str) -> Column:
        """Label of the first window holding ``day``; ``outside`` if none, ``unknown`` if null.

        A CASE over the few configured windows: no join, no shuffle.
        """
        day = F.col(day) if isinstance(day, str) else day
        out = F.when(day.isNull(), F.lit(UNKNOWN))
        for w in self.windows:
            out = out.when(day.between(F.lit(w.start), F.lit(w.end)), F.lit(w.label))
        return out.otherwise(F.lit(OUTSIDE))

    def ordinal(self, label: Column | str) -> Column:
        """1-based position of an event label, for ordering pre < during < post."""
        label = F.col(label) if isinstance(label, str) else label
        return F.array_position(F.array(*[F.lit(x) for x in self.event_labels]), label)

    def window_days(self, spark: SparkSession) -> DataFrame:
        """One row per window and day; its size is known here, before any job runs."""
        rows = [
            (w.label, w.start + timedelta(days=i))
            for w in self.windows
            for i in range((w.end - w.start).days + 1)
        ]
        return spark.createDataFrame(rows, "window_label string, day date")

    def day_count(self) -> int:
        return sum((w.end - w.start).days + 1 for w in self.windows)
