"""Survey analytics on Spark: conform, derive, profile, test and model wide response tables."""
