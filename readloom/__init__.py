"""readloom: short-read preprocessing and quality control on Spark DataFrames."""

__version__ = "0.1.0"
