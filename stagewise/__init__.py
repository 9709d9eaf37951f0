"""Reconciliation analytics over staged record sets, as DataFrame operators for Spark."""
