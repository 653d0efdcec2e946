"""Screening operators over tables, profiles, value counts and verdicts."""
