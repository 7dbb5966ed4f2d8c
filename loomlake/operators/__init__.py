"""Operators over DataFrames: logs, lineage, search, scoring, evidence, rules, tables, retention."""
