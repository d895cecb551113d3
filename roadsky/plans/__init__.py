"""Model plans: which regressions to run."""
