"""Pairwise text-triage analytics as Spark DataFrame plans."""
