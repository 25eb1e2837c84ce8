from tidemark.sources.io import (load_table, preview, read_sensor, read_table,
                                 read_vectors, union_sources, write_table,
                                 write_vectors)

__all__ = ["load_table", "read_table", "read_sensor", "union_sources",
           "write_table", "preview", "write_vectors", "read_vectors"]
