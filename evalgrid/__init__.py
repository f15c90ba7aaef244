"""evalgrid: measurement and evaluation operators over Spark DataFrames and streams."""
