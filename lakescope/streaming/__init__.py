"""Continuous audits."""
