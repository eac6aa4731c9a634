"""Sections of rolled steel: area, heated perimeter, reduced thickness, cladding. Millimetres, and metres of length."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import divided, scaled

SIDES = ("left", "top", "right", "bottom")


def first_dim(dims: Column, *names: str) -> Column:
    """The first of the names that the map has, else 0."""
    return F.coalesce(*(dims[n] for n in names), F.lit(0.0))


def sides(left: Column, top: Column, right: Column, bottom: Column) -> dict[str, Column]:
    """0 or 1 for each side; none heated means all."""
    flags = [F.coalesce(x.cast("int"), F.lit(0)) for x in (left, top, right, bottom)]
    none = sum(flags[1:], flags[0]) == 0
    return {name: F.when(none, 1).otherwise(x) for name, x in zip(SIDES, flags, strict=True)}


def i_beam_area(h: Column, b: Column, s: Column, t: Column, r: Column) -> Column:
    return h * s + 2 * t * (b - s) + (4 - math.pi) * r * r


def i_beam_perimeter(h: Column, b: Column, s: Column, r: Column, on: dict[str, Column]) -> Column:
    side = h + (b - s) - (4 - math.pi) * r
    return (on["left"] + on["right"]) * side + (on["top"] + on["bottom"]) * b


def section_area(shape: Column, h: Column, b: Column, s: Column, t: Column, r: Column) -> Column:
    """By the start of the shape's name; bent channels come before rolled ones, as they share the start."""
    return (
        F.when(shape.startswith("I-beam"), i_beam_area(h, b, s, t, r))
        .when(shape.startswith("channel_bent"), t * (h + 2 * b - 4 * t))
        .when(shape.startswith("channel"), h * s + 2 * t * (b - s))
        .when(shape.startswith("corner"), t * (h + b - t))
        .when(shape.startswith("tube_round"), math.pi * t * (h - t))
        .when(shape.startswith("tube"), 2 * t * (h + b - 2 * t))
        .when(shape.startswith("round"), math.pi * h * h / 4)
        .otherwise(h * b)
    )


def reduced_thickness(area: Column, perimeter: Column) -> Column:
    return scaled(divided(area, perimeter), 1)


def corners(on: dict[str, Column]) -> Column:
    """Corners between two heated sides."""
    pair = lambda a, b: (on[a] * on[b])
    return pair("top", "right") + pair("left", "top") + pair("right", "bottom") + pair("bottom", "left")


def cladding(h: Column, b: Column, t: Column, delta: Column, length: Column, on: dict[str, Column]) -> tuple[Column, Column]:
    """Of a boxed I-beam: area with the strips between the flanges, and area alone."""
    outer = (on["left"] + on["right"]) * h + (on["top"] + on["bottom"]) * b + corners(on) * delta
    strips = (on["right"] + on["left"]) * (h - 2 * t)
    alone = outer / 1000 * length
    return alone + (strips / 1000) * 0.1 * (length / 0.6), alone


def mass_per_metre(area: Column, density: float = 7850.0) -> Column:
    return area * density / 1e6


def length_from_mass(kg: Column, per_metre: Column) -> Column:
    return scaled(divided(kg, per_metre), 2)
