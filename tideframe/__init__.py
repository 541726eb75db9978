"""tideframe: analytics over labelled, keyed timelines as Spark DataFrames."""
