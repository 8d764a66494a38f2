"""Column functions: redaction chains, exact spans, hashes and small text helpers."""
