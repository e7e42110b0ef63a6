"""Reading matrices and tables, writing partitioned Parquet and small summary tables."""
