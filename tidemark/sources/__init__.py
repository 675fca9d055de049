"""Readers of candles, dimensions and logs, and the tables that are derived from the driver's."""
