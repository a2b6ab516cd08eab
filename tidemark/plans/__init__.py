"""Plans: DataFrames that say what a pull, a push or a reconcile would do."""
