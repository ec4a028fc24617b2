"""Column expressions: calendar, missing values, normal quantiles, codes."""
