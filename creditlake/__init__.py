"""creditlake: credit-risk data work as plain Spark DataFrame / SQL jobs.

Sub-packages:
  sources    typed readers (driver parquet, CSV, JDBC, synthetic) and test adapters
  functions  Column builders (hash keys, JSON packs, decisions, coercions)
  operators  DataFrame -> DataFrame building blocks (vault, features, ranking, ...)
  plans      composite jobs (vault load, training mart, explanations, CRM views)
  streaming  Structured Streaming versions of the ingest and scoring jobs
"""

__version__ = "0.1.0"
