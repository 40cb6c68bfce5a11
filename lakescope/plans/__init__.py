"""Whole audits put together from sources and operators, and their outputs."""
