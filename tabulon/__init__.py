"""tabulon: checklists of query shapes and result comparison on Spark DataFrames."""

__version__ = "0.1.0"
