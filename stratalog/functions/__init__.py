"""Part of the triage engine."""
