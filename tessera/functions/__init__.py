"""Column functions: tokens, scores, ranges, query analysis."""
