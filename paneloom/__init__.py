"""Panel analytics on Spark: ingest, harmonise, de-duplicate, design, estimate, audit."""
