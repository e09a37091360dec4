"""Column expressions and the few vectorised functions that Spark lacks."""
