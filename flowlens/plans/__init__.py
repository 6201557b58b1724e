"""Query plans: dashboard endpoints, the batch pipeline and the registered query set."""
