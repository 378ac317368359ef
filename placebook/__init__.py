"""placebook: place-centred expenditure analytics expressed as Spark DataFrames."""
