"""Frame operators: order, splits, samples, grading, metrics, runs, reports."""
