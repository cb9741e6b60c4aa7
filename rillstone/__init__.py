"""rillstone: relational, temporal and data-preparation operators written Spark-first.

Every operator is a function from DataFrame to DataFrame (or a Column builder);
Catalyst chooses the physical plan. See README.md for the map of modules.
"""

__version__ = "0.1.0"
