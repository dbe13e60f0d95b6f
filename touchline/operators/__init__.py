"""DataFrame operators: ordering, rolling form, ratings, matching, aggregates, metrics, calibration."""
