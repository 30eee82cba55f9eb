"""nearfield: sparse-similarity analytics expressed as PySpark DataFrame plans."""
