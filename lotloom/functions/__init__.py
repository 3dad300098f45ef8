"""Column expressions that normalise what lists say."""
