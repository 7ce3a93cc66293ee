"""Message-processing pipelines as named dataflow graphs on Spark."""
