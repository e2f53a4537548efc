"""Inputs: feature tables, splits and views."""
