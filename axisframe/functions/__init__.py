"""Expressions and selectors."""
