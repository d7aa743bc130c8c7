"""Analytics over multichannel sampled signals and interval events, on Spark DataFrames."""
