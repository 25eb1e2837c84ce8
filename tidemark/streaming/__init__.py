from tidemark.streaming.sensor import daily_extremes_stream, run_to_table

__all__ = ["daily_extremes_stream", "run_to_table"]
