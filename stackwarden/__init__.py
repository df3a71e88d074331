"""De-duplication, similarity grouping and filing of large asset tables, as Spark jobs."""
