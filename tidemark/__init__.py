"""tidemark: DataFrame, SQL and Structured Streaming implementations of dataflow workloads."""
