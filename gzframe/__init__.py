"""gzframe: gzip streams as queryable Spark relations."""

__version__ = "0.1.0"
