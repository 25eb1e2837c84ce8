from tidemark.functions.exprs import (all_not_null, col_of, euclidean,
                                      md5_below, md5_key,
                                      md5_threshold, nan_to_null,
                                      pair_count, row_mean, safe_corr)

__all__ = ["all_not_null", "col_of", "euclidean", "md5_below", "md5_key", "md5_threshold",
           "nan_to_null", "pair_count", "row_mean", "safe_corr"]
