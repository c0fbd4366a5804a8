"""Whole plans and the registered queries."""
