"""Error analytics as Spark plans: groups, series, baselines, correlations and health of what applications report."""
