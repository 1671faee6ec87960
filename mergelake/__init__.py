"""mergelake: a transactional merge-on-read table layer and query library for PySpark."""

__version__ = "0.1.0"
