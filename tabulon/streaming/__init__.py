"""Event log: ingest, consent, sessions, redaction."""
