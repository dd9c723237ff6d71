"""assay: statistical verification and data-processing operators as PySpark DataFrame functions."""

__version__ = "0.1.0"
