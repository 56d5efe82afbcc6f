"""weir: a continuous-dataflow graph layer over Spark DataFrames."""
