"""Shotloom: Spark DataFrame operators for time-segmented media catalogs."""

__version__ = "0.1.0"
