"""nightfold: forecast verification over time and place, expressed as Spark DataFrame operators."""
