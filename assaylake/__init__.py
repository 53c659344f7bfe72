"""Lab-result analytics on Spark: events to cleaned results, case contexts and report gates."""
