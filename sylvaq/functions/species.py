"""Species names and allometric equations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Species ids and names, the two catch-all categories.
NAMES = {
    1: "General_Conifer",
    2: "General_Broadleaf",
    3: "Acer",
    4: "Alnus",
    5: "Betula",
    6: "Pinus",
    7: "Prunus",
    8: "Quercus",
    9: "Sorbus",
    10: "Tilia",
    11: "Ulmus",
}
GENERAL = ("General_Conifer", "General_Broadleaf")

# Published equation coefficients. Biomass in kg from stem diameter d (cm) and height h (m).
CONIFER = (-3.198, 9.547, 12.0, 3.241, 20.0)
BIRCH = (-3.654, 10.582, 12.0, 3.018, 22.0)
HEIGHT_FORM = {"Pinus": CONIFER, "General_Conifer": CONIFER, "Betula": BIRCH, "General_Broadleaf": BIRCH}
LOG_FORM = {"species": ("Acer", "Sorbus", "Tilia", "Prunus", "Ulmus"), "a": -1.9958, "b": 2.3625}
POWER_FORM = {"species": ("Alnus",), "a": 0.000146, "b": 2.6035333}
LOG10_FORM = {"species": ("Quercus",), "a": -1.7194, "b": 1.0414}
CARBON_SHARE = 0.5


def species_name(species: Column) -> Column:
    """Name of a species id; NULL for ids outside the list."""
    pairs = [F.lit(x) for item in NAMES.items() for x in item]
    return F.element_at(F.create_map(*pairs), species.cast("int"))


def is_general(name: Column) -> Column:
    """Whether the name is a catch-all category; false for NULL."""
    return F.coalesce(name.isin(*GENERAL), F.lit(False))


def biomass(name: Column, d: Column, h: Column) -> Column:
    """Tree biomass in kg: 0 for unknown species, diameters not above 0, and where the equation breaks down.

    A height of 0 gives 0 in the log10 form and a negative one NULL; a height
    at the pole of the height form gives 0.
    """

    def height_form(b0: float, b1: float, k1: float, b2: float, k2: float) -> Column:
        ds = 2 + 1.25 * d
        pull = F.try_divide(h, h + k2)
        return F.coalesce(F.exp(b0 + b1 * (ds / (ds + k1)) + b2 * pull), F.lit(0.0))

    expr = F.when(name.isNull() | (d <= 0), F.lit(0.0))
    for form in sorted(set(HEIGHT_FORM.values())):
        expr = expr.when(name.isin(*[s for s, f in HEIGHT_FORM.items() if f == form]), height_form(*form))
    expr = expr.when(name.isin(*LOG_FORM["species"]), F.exp(LOG_FORM["a"] + LOG_FORM["b"] * F.ln(d)))
    expr = expr.when(name.isin(*POWER_FORM["species"]), POWER_FORM["a"] * F.pow(d * 10, F.lit(POWER_FORM["b"])))
    oak = F.when(h == 0, F.lit(0.0)).when(h > 0, F.pow(F.lit(10.0), LOG10_FORM["a"] + LOG10_FORM["b"] * F.log10(h * d * d)))
    return expr.when(name.isin(*LOG10_FORM["species"]), oak).otherwise(0.0)


def polynomial_biomass(d: Column, h: Column, inter: float, slope: float) -> Column:
    """The linear form in d * d * h, which none of the listed species uses."""
    return inter + slope * d * d * h
