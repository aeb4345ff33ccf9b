"""Column builders.  Everything here returns a ``pyspark.sql.Column`` made of
built-in expressions, so it stays inside whole-stage codegen (no Python UDF)."""
