"""evenhand: group-fairness audits of classifiers as Spark DataFrame jobs."""
