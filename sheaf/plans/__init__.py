"""Plan-level helpers: shared staging, sessions, whole pipelines."""
