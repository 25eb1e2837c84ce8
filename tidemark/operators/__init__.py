"""Table operators: every one is ``DataFrame -> DataFrame`` over named columns."""
