"""Readers and writers of stored logs, units, envelopes and reports."""
