"""lexigraph: knowledge graphs from text, as Spark jobs."""
