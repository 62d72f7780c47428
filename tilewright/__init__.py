"""Annotated image datasets as Spark tables: tiling, cleaning, splitting, matching, bagging, scoring."""
