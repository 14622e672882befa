"""Marlstone: multi-tenant infrastructure telemetry analytics, native to PySpark."""
