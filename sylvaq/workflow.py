"""The workflow's functions by the names its users know, over Spark columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaq.functions.clean import significance_label
from sylvaq.functions.species import biomass
from sylvaq.operators import growth_models, panel, regression
from sylvaq.operators.inventory import impute_diameters


def _column(x: Column | str | float | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def calculate_biomass(species: Column | str | None, dbh_cm: Column | float, height_m: Column | float) -> Column:
    """Biomass in kg of columns or plain values; see functions.species.biomass."""
    return F.coalesce(biomass(_column(species), _column(dbh_cm).cast("double"), _column(height_m).cast("double")), F.lit(0.0))


def get_smart_prediction(trees: DataFrame, models: DataFrame, with_rmse: bool = True) -> DataFrame:
    """Trees with every year's diameter, the model that gave it and its error; see inventory.impute_diameters."""
    return impute_diameters(trees, models, with_rmse=with_rmse)


def get_significance_label(p: Column | float | None) -> Column:
    return significance_label(_column(p).cast("double"))


def calculate_vif(df: DataFrame, features: list[str]) -> DataFrame:
    return regression.vif(df, features)


def create_long_dataframe(df: DataFrame, key: str) -> DataFrame:
    """The filled panel: one row per tree and period."""
    return panel.median_filled(panel.long_panel(df, key))


def analyze_species(long: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coefficients, test-set scores and the status of every species and of all together; ``order`` is unique within ``long``."""
    grouped = panel.with_pooled(long)
    return growth_models.coefficient_table(grouped), growth_models.performance(grouped, order), growth_models.fit_status(grouped)


def plot_tile_matrix(coefficients: DataFrame) -> DataFrame:
    """The cells to draw; the legend is growth_models.tile_legend."""
    return growth_models.tile_matrix(coefficients)
