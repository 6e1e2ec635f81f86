"""PySpark jobs over API request logs: parse, validate, estimate, scan, limit, decide, report."""
