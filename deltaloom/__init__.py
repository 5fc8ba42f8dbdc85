"""deltaloom: binary delta analytics and delta patching on PySpark."""

__version__ = "0.1.0"
