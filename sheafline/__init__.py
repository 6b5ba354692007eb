"""Document selection and assembly on Spark."""

__version__ = "0.1.0"
