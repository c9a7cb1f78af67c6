"""Media-manifest analytics and text-corpus operators on Spark."""
