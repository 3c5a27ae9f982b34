"""Domain operators: DataFrame in, DataFrame out."""
