"""tessera: panel (entity x time) features, stacked-model meta-features,
exact evaluation metrics, report tables, data quality, scoring and
monitoring on Spark DataFrames."""

__version__ = "0.1.0"
