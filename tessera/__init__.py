"""Tessera: scenes, meshes, tiles and exchange text as Spark DataFrames."""
