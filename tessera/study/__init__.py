"""Governed studies: contracts, firewalls, pre-registration, verdicts, provenance, and the runner."""
