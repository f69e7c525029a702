"""spanloom: time-coded tag analytics on Spark (spans, markers, totals, tuning, result upserts)."""
