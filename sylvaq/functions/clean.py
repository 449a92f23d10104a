"""Cleaning and labelling expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(c: Column, kind: str = "string") -> Column:
    """A finite double: text that is not a plain number, NaN and infinities become NULL."""
    v = F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double")) if kind == "string" else c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def nonzero(c: Column) -> Column:
    """Zero as missing."""
    return F.when(c != 0, c)


def mean_present(a: Column, b: Column) -> Column:
    """Mean of the values present; NULL if neither is."""
    return F.coalesce((a + b) / 2, a, b)


#: Soil codes looked for anywhere in the lower-cased text, overlapping.
SOIL_CODES = {"soil_has_infill": "t", "soil_has_silt_sand": "s+h", "soil_has_clay": "sa", "soil_has_moraine": "mr", "soil_has_bedrock": "ka"}


def soil_flags(soil: Column) -> dict[str, Column]:
    """0/1 columns for the soil codes; 0 where soil is NULL."""
    low = F.lower(F.coalesce(soil, F.lit("")))
    return {name: low.contains(code).cast("int") for name, code in SOIL_CODES.items()}


def significance_label(p: Column) -> Column:
    """Stars of a p-value; 'ns' from 0.05 up and where there is none."""
    return F.when(p < 0.001, "* * *").when(p < 0.01, "* *").when(p < 0.05, "*").otherwise("ns")


def display_name(variable: Column) -> Column:
    """A variable's name for reports: fixed replacements, one after another."""
    for old, new in (("type_", ""), ("soil_has_", ""), ("Log_Initial_H", "Height (Log)"), ("Density25", "Density (25m)"), ("Mono_Rate", "Biotic Rate")):
        variable = F.replace(variable, F.lit(old), F.lit(new))
    return variable
