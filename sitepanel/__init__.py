"""Site panels on Spark: climate features, lagged panels, mixed models and plot tables."""
