"""Stellar-catalog analytics as plain ``DataFrame -> DataFrame`` functions on PySpark."""
