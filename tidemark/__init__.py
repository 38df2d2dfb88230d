"""Move, join and audit event streams and tables with Spark."""
