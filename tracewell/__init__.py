"""tracewell: a PySpark library of forensic operators over bank, telecom and ledger tables."""
