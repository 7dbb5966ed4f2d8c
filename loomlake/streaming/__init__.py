"""Incremental state: projection units over streams and checkpoints, block assembly, timers, frames."""
