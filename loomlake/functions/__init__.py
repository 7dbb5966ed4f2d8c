"""Column functions: exact decimals, texts, JSON values, ranges and boxes."""
