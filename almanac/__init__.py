"""almanac: event extraction, scoring, resolution and serving as Spark jobs."""
