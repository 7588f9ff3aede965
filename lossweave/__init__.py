"""Text similarity search and clustering over tables of free-text claims, as Spark DataFrames."""
