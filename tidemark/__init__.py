"""tidemark: panel analytics for points observed over years, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` that takes its
column names as arguments and runs as Spark SQL / Spark ML work.

Sub-packages
------------
sources    readers and writers (CSV with a units line, parquet, samples)
functions  column expressions and small scalar helpers (NULL-safe maths,
           distribution tails)
operators  the table operators: cleaning, enrichment, reshaping, statistics,
           models, neighbour graphs, clustering
plans      the operators bound to the driver's test tables, with the SQL
           that checks them
streaming  the sensor roll-up over a stream of files
"""

from tidemark.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
