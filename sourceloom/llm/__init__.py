"""Corpus preparation operators: scans, joins, audits, mixing, scoring and chat repair."""
