"""Registered queries of the triage engine."""
