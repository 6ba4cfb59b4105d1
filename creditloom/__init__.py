"""Credit-risk features, scorecards and model reports as Spark DataFrame operators."""
