"""ratiocert: likelihood-ratio certificates over score tables, as Spark DataFrame jobs."""

__version__ = "0.1.0"
