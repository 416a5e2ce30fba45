"""Operators of the table comparison: splits, key scans, row comparison, filters, statistics, schema sets."""
