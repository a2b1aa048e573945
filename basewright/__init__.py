"""Background models of genomic sequence as Spark batch jobs."""
