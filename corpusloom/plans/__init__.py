"""Query registry, its SQL, and the runner of stages."""
