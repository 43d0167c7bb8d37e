"""martloom: retail data-mart jobs as Spark DataFrame functions."""
