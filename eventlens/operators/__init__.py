"""Model, audit, analysis and experiment operators: DataFrame in, DataFrame out."""
