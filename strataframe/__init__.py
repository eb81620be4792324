"""Map algebra, river networks and recipes over grids of cells, as Spark DataFrames."""
