"""Operators: DataFrame in, DataFrame out; where nothing else is said they work on bounded and streaming frames alike."""
