"""larkseek: multi-tenant entity search and change-data jobs on Spark DataFrames."""
