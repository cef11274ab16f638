"""Readers with stated schemas, and staging of formats that Spark does not read by itself."""
