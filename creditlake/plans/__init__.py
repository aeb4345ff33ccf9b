"""Composite jobs built from sources, functions and operators."""
