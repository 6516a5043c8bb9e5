"""Profiles, quality alerts and readiness findings, as DataFrames."""
