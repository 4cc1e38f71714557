"""Relational operators over series: resample, series, event study, notes."""
