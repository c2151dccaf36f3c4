"""Readers and idempotent writers of ledger tables."""
