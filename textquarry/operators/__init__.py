"""Set-oriented operators: DataFrame in, DataFrame out."""
