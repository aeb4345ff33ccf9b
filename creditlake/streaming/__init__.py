"""Structured Streaming jobs: incremental file ingest (R-01) and continuous
scoring with a latest-result-per-application view (R-02)."""
