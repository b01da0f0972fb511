"""Multi-step plans: loading and splitting, model runs, hybrid sweeps, query registry."""
