"""lexloom: document-originality analytics and text processing on Spark DataFrames."""
