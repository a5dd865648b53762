"""Observability analytics (errors, logs, spans, metrics) as Spark DataFrame code."""
