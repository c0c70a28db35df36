"""Usage and authorship analytics over append-only logs, as Spark plans."""
