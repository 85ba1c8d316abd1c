"""Click-log features, profiles, splits, scoring and blending as Spark DataFrame operators."""
