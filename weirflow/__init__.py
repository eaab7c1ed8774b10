"""A Spark-first dataflow engine: operators, expressions and control flow compiled to DataFrames."""
