"""Options of the two pipelines, checked on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields

from permaway.operators.track import check_densify


def prefix_number(text: str) -> float:
    """The number a text begins with, NaN where there is none."""
    m = re.match(r"\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))", text)
    return float(m[1]) if m else math.nan


@dataclass(frozen=True)
class CenterlineOptions:
    """Drawn paths to centerlines; lengths in metres."""

    max_segment: float = 800.0
    densify_spacing: float = 600.0
    output_spacing: float = 25.0
    spline_detail: int = 60
    curve_arc: float = 100.0
    straight_threshold: float = 5000.0
    find_curves: bool = True

    def __post_init__(self):
        for f in fields(self):
            if isinstance(v := getattr(self, f.name), float) and math.isnan(v):
                raise ValueError(f"{f.name} is no number")
        check_densify(self.max_segment, self.densify_spacing)
        if not self.output_spacing > 0:
            raise ValueError("output_spacing must be positive")
        if self.spline_detail < 0:
            raise ValueError("spline_detail must not be negative")

    @classmethod
    def curve_finding(cls) -> CenterlineOptions:
        return cls(max_segment=300.0, densify_spacing=200.0, output_spacing=5.0)

    @classmethod
    def parse(cls, **texts: str | bool) -> CenterlineOptions:
        """From the texts of a form: numbers by their prefix, ``spline_detail`` cut to a whole number."""
        read = {k: v if isinstance(v, bool) else prefix_number(v) for k, v in texts.items()}
        if "spline_detail" in read:
            if math.isnan(read["spline_detail"]):
                raise ValueError("spline_detail is no number")
            read["spline_detail"] = int(read["spline_detail"])
        return cls(**read)


@dataclass(frozen=True)
class DrawingOptions:
    """Centerlines to drawn lines."""

    exaggeration: float = 1.0
    offset: float = 3.0
    altitude_mode: str = "clampToGround"
    legacy_zero_defaults: bool = False  # an explicit 0 counts as the default

    def __post_init__(self):
        if self.legacy_zero_defaults:
            object.__setattr__(self, "exaggeration", self.exaggeration or 1.0)
            object.__setattr__(self, "offset", self.offset or 3.0)
