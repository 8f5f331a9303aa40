"""Boxes as four columns or a struct (x0, y0, x1, y1); origin top left, y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAND = 0.05  # share of the page height at top and bottom that holds page furniture
SIDE = 0.08  # share of the page width at the sides
FULL_WIDTH = 0.6  # wider than this share of the content is full width
OVERHANG = 0.15  # least overhang of the centre line on both sides, as a share of the content width


def box(x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.struct(c(x0).alias("x0"), c(y0).alias("y0"), c(x1).alias("x1"), c(y1).alias("y1"))


def prefixed(prefix: str) -> Column:
    """The box in the columns <prefix>x0 .. <prefix>y1."""
    return box(*[f"{prefix}{k}" for k in ("x0", "y0", "x1", "y1")])


def parse_box(text: Column) -> Column:
    """A box from a JSON array of four numbers; null if it is not one."""
    a = F.from_json(text, "array<double>")
    return F.when(F.size(a) == 4, box(a[0], a[1], a[2], a[3]))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def centre_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def x_overlap(a: Column, b: Column) -> Column:
    return F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])


def y_overlap(a: Column, b: Column) -> Column:
    return F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])


def intersects(a: Column, b: Column) -> Column:
    """Whether the boxes share a positive area."""
    return (x_overlap(a, b) > 0) & (y_overlap(a, b) > 0)


def intersection(a: Column, b: Column) -> Column:
    return F.when(intersects(a, b), x_overlap(a, b) * y_overlap(a, b)).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    s = F.least(area(a), area(b))
    return F.when(s > 0, intersection(a, b) / s).otherwise(0.0)


def centre_inside(a: Column, b: Column) -> Column:
    return centre_x(a).between(b["x0"], b["x1"]) & centre_y(a).between(b["y0"], b["y1"])


def mostly_inside(a: Column, b: Column, share: float = 0.7) -> Column:
    return (area(a) > 0) & (intersection(a, b) >= share * area(a))


def pad(b: Column, by: Column | float, width: Column, height: Column) -> Column:
    """The box grown by a margin and clipped to the page."""
    return box(F.greatest(F.lit(0.0), b["x0"] - by), F.greatest(F.lit(0.0), b["y0"] - by), F.least(width, b["x1"] + by), F.least(height, b["y1"] + by))


def in_band(b: Column, height: Column) -> Column:
    """Wholly inside the top or bottom band of the page."""
    return (b["y1"] <= height * BAND) | (b["y0"] >= height * (1 - BAND))


def full_width(b: Column, content_x0: Column, content_x1: Column) -> Column:
    width = content_x1 - content_x0
    middle = (content_x0 + content_x1) / 2
    return (b["x1"] - b["x0"] > FULL_WIDTH * width) | ((middle - b["x0"] >= OVERHANG * width) & (b["x1"] - middle >= OVERHANG * width))


def expand_down(b: Column, obstacle_top: Column, page_height: Column) -> Column:
    """The bottom grown to 3 pt above the next obstacle or 2 pt above the page end; null if 0.1 pt or less is gained."""
    to = F.least(F.coalesce(obstacle_top - 3, page_height - 2), page_height - 2)
    return F.when(to - b["y1"] > 0.1, to)


def force_down(b: Column, line_height: Column, page_height: Column) -> Column:
    """The bottom grown by one line, at most to the page end."""
    return F.least(b["y1"] + line_height, page_height)


def largest_fit(width_chars: Column, room: Column, low: float = 0.3, high: float = 1.0, steps: int = 7) -> Column:
    """Binary search for the largest scale whose square times `width_chars` fits the room, in a fixed number of steps."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fits = mid * mid * width_chars <= room
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]
    return F.when(width_chars * high * high <= room, F.lit(high)).otherwise(found)


def scroll_to(top: Column, height: Column, client: Column, other_height: Column, other_client: Column) -> Column:
    """The proportional scroll position in a second view."""
    return F.when(height - client <= 0, 0.0).otherwise(top / (height - client) * F.greatest(other_height - other_client, F.lit(0.0)))
