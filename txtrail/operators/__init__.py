"""Relational operators: DataFrame in, DataFrame out, the same in batch and in foreachBatch."""
