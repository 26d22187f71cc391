"""DataFrame operators: features, scoring, queries, review, evaluation."""
