"""statefold: ordered, segmented and gated sequence analytics on PySpark DataFrames."""

__version__ = "0.1.0"
