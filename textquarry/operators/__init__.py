"""DataFrame operators: policy scan, log parsing, triage, tables, lexicons, evidence."""
