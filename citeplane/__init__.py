"""citeplane: citation verification and corpus analytics, declared as Spark plans."""

__version__ = "0.1.0"
