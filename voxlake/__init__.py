"""voxlake: dense volumes, their contrast mappings and interaction events as Spark DataFrames."""
