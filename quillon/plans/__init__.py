"""Plan-level helpers: cutting lineage, session set-up."""
