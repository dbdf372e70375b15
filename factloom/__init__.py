"""Knowledge-fact distillation on Spark DataFrames."""
