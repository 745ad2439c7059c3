"""Plan-level operators: DataFrame -> DataFrame transforms over ordered points."""
