"""taintgauge: Spark-first measurement and governance of synthetic contamination in tabular corpora."""

__version__ = "0.1.0"
