"""Default probabilities as scorecard points and back."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities nearer to 0 or 1 than this count as this near.
EDGE = 1e-6


@dataclass(frozen=True)
class PointsScale:
    """A straight line from the log-odds of paying to points, cut to a range.

    Fixed values: odds of 20 to 1 stand at 650 points, 50 points double the odds, points run from 300 to 900.
    """

    doubling: float = 50.0
    anchor_odds: float = 20.0
    anchor_points: float = 650.0
    least: float = 300.0
    most: float = 900.0

    def line(self) -> tuple[float, float]:
        """Points at even odds, and points per unit of log-odds."""
        slope = self.doubling / math.log(2)
        return self.anchor_points - slope * math.log(self.anchor_odds), slope

    def points(self, p: Column) -> Column:
        even, slope = self.line()
        inner = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
        line = even + slope * F.ln((1 - inner) / inner)
        return F.when(p.isNotNull(), F.least(F.greatest(line, F.lit(float(self.least))), F.lit(float(self.most))))

    def probability(self, points: Column) -> Column:
        even, slope = self.line()
        return 1 / (1 + F.exp((points - even) / slope))
