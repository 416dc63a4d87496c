"""Operators over report, result, evidence and job tables."""
