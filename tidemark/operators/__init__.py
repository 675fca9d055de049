"""Operators on candle tables: indicators, zones, joins, scans, labels, statistics and logs."""
