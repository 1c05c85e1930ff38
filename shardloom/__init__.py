"""shardloom: sharded-SQL and columnar analytics on PySpark."""

__version__ = "0.1.0"
